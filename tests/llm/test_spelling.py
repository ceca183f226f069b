import random
import re
import zlib
from collections import Counter

import numpy as np

from catalink.llm import queries, spelling
from tests.conftest import SMALL
from tests.llm.helpers import clashing, docs

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def slips(key, run, one_in=199):
    h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1 :] if h % one_in == 0 else run


def at_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def brute(rows, one_in=199):
    counts = Counter()
    for key, text in rows:
        counts.update(slips(key, run.translate(LOWER), one_in) for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""))
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    alphabet = {c for w in words for c in w}

    def near(w):  # all strings at one edit that are words
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        made = {a + b[1:] for a, b in cuts if b} | {a + c + b for a, b in cuts for c in alphabet} | {a + c + b[1:] for a, b in cuts if b for c in alphabet}
        return [v for v in made - {w} if v in words]

    near_of = {w: near(w) for w in words}
    form = {}
    for w, n in words.items():
        if near_of[w]:
            best = min(near_of[w], key=lambda v: (-words[v], v))
            if words[best] >= 5 * n:
                form[w] = best
    out = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near_of[w]), words[form[w]] if w in form else None))
    return out


def found(df, **parameters):
    return {tuple(r) for r in spelling.variant_groups(df, **parameters).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_whole_table_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op11_spelling(spark, SMALL).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert any(r[1] for r in got) and any(r[4] for r in got)


def test_chains_ties_nulls_and_repeated_rows(spark):
    texts = ["abcdefgh " * 700, "abcdefgx " * 130, "abcdefyx " * 25, "abcdezyx\t" * 5, "AbcdefgH", None, "", "Éabcdé " * 30 + "éabcdé " * 30, "aéabcdé " * 6, "ÀÖ×÷ÿßàabc " * 9]
    texts += ["abcdef" * 2 + "," + "abcdefabcdeg " * 6, "x" * 400_000 + " lettersé"]
    ids = [*range(len(texts) - 1), None]
    df = docs(spark, texts + texts, ids=ids + ids)
    rows = list(zip(ids + ids, texts + texts))
    got = found(clashing(df), one_in=7)
    assert got == brute(rows, 7)
    df = docs(spark, texts)
    got = {r[0]: r for r in found(df)}
    assert got["abcdezyx"][1:3] == ("abcdefyx", "abcdefgh")


def test_texts_longer_than_a_slice(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 50)
    monkeypatch.setattr(spelling, "HELD", 20)
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choice("abcé") for _ in range(draw.randint(4, 8))) for _ in range(900)) for _ in range(6)]
    assert found(docs(spark, texts)) == brute(list(enumerate(texts)))
    assert b"".join(spelling._slices(texts[0].encode())) == texts[0].encode()


def test_all_near_words_share_a_signature():
    draw = np.random.default_rng(5)
    for _ in range(2000):
        word = "".join(draw.choice(list("abcdeéstnr"), draw.integers(5, 14)))
        at, other, kind = int(draw.integers(len(word))), str(draw.choice(list("abcdxyzö"))), int(draw.integers(3))
        changed = word[:at] + ("", other, other + word[at])[kind] + word[at + 1 :]
        assert word == changed or at_one(word, changed) and set(spelling.signatures(word)) & set(spelling.signatures(changed))
    assert len(set(spelling.signatures("abcdef"))) == 21


def test_an_empty_table(spark):
    assert found(docs(spark, [])) == set()
    assert found(docs(spark, [None, "", "short a b c"])) == set()
