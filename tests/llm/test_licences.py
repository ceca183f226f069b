import re

import pytest

from catalink.llm import licences
from tests.conftest import SMALL
from tests.llm.helpers import clashing, docs


def brute(rows, templates, percent):
    out = []
    sets = {n: set(licences.template_bigrams(t)) for n, t in templates.items()}
    for key, text in rows:
        if text is None:
            continue
        paragraphs = re.split(r"\n[\x20\x09-\x0D]*\n", text)
        units = [("line", i, t) for i, t in enumerate(text.split("\n"))]
        units += [("paragraph", i, t) for i, t in enumerate(paragraphs) if "\n" in t]
        units += [("text", 0, text)] if len(paragraphs) > 1 else []
        for unit, place, t in units:
            own = set(licences.template_bigrams(t))
            scores = [(-2 * len(own & s) / (len(own) + len(s)), n) for n, s in sets.items() if own and s]
            best = min(scores, default=(0, ""))
            if -best[0] >= percent / 100:
                out.append((key, unit, place, best[1], -best[0]))
    return sorted(out, key=repr)


def found(df, **parameters):
    return sorted((tuple(r) for r in licences.scan(df, **parameters).collect()), key=repr)


MIT = licences.TEMPLATES["MIT"]
WRAPPED = re.sub(r"(.{60,75}) ", r"\1\n", MIT)
TEXTS = [
    None, "", "\n\n", "All rights reserved.", "all RIGHTS, reserved!", "Rights reserved.", "Released under the MIT License", MIT, MIT.upper(),
    WRAPPED, "Title\n\n" + WRAPPED + "\n \nThe end", "prose " * 5000, "prose\n" * 3000 + "Licensed under CC BY-NC 4.0.\n",
    WRAPPED.replace("Software", "Work"), "MIT", "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.",
    MIT[:600] + "\n\n" + MIT[600:], "This work is licensed under the GNU Lesser General Public License, version 3.",
]


@pytest.mark.parametrize("percent", [60, 80, 100])
def test_units_equal_brute_force(spark, percent):
    df = docs(spark, TEXTS + TEXTS[3:5])
    want = brute([(r["doc_id"], r["text"]) for r in df.collect()], licences.TEMPLATES, percent)
    assert found(clashing(df), percent=percent) == want and len(want) > 5


def test_size_bounds_never_lose_a_match():
    for percent in (50, 80, 85, 100):
        for size in range(1, 60):
            low, high = licences.bounds(size, percent)
            for n in range(1, 200):
                reachable = 2 * min(n, size) * 100 >= percent * (n + size)
                assert reachable == (low <= n <= high)


def test_one_word_templates_ties_and_nothing(spark):
    df = docs(spark, ["Proprietary", "proprietary!", "x"])
    assert found(df, templates={"b": "proprietary", "a": "Proprietary."}) == [(0, "line", 0, "a", 1.0), (1, "line", 0, "a", 1.0)]
    assert found(df, templates={}) == [] and found(df, templates={"e": ""}) == []
    assert found(docs(spark, [])) == []


def test_documents_of_the_small_table_without_python(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = licences.scan(df)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute([(r["doc_id"], r["text"]) for r in df.collect()], licences.TEMPLATES, 80)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def best_run(words, template, percent):
    """The greatest coefficient of any run of words, every one tried."""
    want, best = set(licences.template_bigrams(template)), 0
    for i in range(len(words)):
        own = set()
        for j in range(i + 1, min(len(words), i + 4 * len(want))):
            own.add(f"{words[j - 1]} {words[j]}")
            best = max(best, 2 * len(own & want) / (len(own) + len(want)))
    return best if best >= percent / 100 else None


PARTS = re.sub(r"(subject to the following conditions:|portions of the Software\.) ", r"\1\n\n", MIT)
PROSE = "\n".join(f"Line {i} of the text tells of the use of the software number {i * i}." for i in range(150))


def test_split_licences_inside_long_documents(spark):
    assert PARTS.count("\n\n") == 2
    wrapped = "\n\n".join(re.sub(r"(.{60,75}) ", r"\1\n", p) for p in PARTS.split("\n\n"))
    texts = [
        f"{wrapped}\n\n{PROSE}", f"{PROSE}\n\n{wrapped}", f"{PROSE}\n\n{PARTS}\n\n{PROSE}\n\n{wrapped}\n{wrapped}\n", PROSE,
        re.sub("(?m)^", " * ", wrapped) + "\n" + PROSE, "This project is released under the MIT License.", f"{PROSE} (c) 2020 A. B., all rights reserved, and {PROSE}",
        "All rights reserved.\nIt is so that all rights reserved stay.", f"{PROSE}\n{MIT[:400]}",
    ]
    got = found(docs(spark, texts))
    before = len(re.findall(r"[^\W_]+", PROSE))
    length = len(re.findall(r"[^\W_]+", MIT))
    second = 2 * before + length
    assert got == sorted([
        (0, "run", 0, "MIT", 1.0), (1, "run", before, "MIT", 1.0),
        (2, "run", before, "MIT", 1.0), (2, "run", second, "MIT", 1.0), (2, "run", second + length, "MIT", 1.0),
        (2, "paragraph", 7, "MIT", 13 / 14),  # the end of one copy and most of the next
        (4, "run", 0, "MIT", 1.0), (5, "run", 3, "MIT notice", 1.0), (6, "run", before + 4, "All rights reserved", 1.0),
        (7, "line", 0, "All rights reserved", 1.0), (7, "run", 7, "All rights reserved", 1.0),
    ], key=repr)


def test_runs_equal_brute_force_on_edited_texts(spark):
    import random

    draw = random.Random(3)
    template = "a b c a b d e f g a c h i j k l b c"
    texts = []
    for _ in range(150):
        words = template.split()
        for _ in range(draw.randrange(6)):
            i = draw.randrange(len(words))
            words[i:i + draw.randrange(2)] = draw.choices("abcxyz", k=draw.randrange(3))
        texts.append(" ".join(draw.choices("abcdxyz", k=draw.randrange(30)) + words + draw.choices("abcdxyz", k=draw.randrange(30))))
    got = {}
    for key, _, _, _, dice in found(docs(spark, texts), templates={"t": template}):
        got[key] = max(dice, got.get(key, 0))
    want = {i: b for i, t in enumerate(texts) if (b := best_run(t.split(), template, 80))}
    assert got.keys() == want.keys() and len(want) > 20


def test_texts_and_headers_of_common_licences(spark):
    names = [
        "Apache-2.0", "Apache-2.0 header", "GPL-2.0", "GPL-3.0", "GPL-3.0 header", "LGPL-2.1", "LGPL-3.0 header", "AGPL-3.0 header", "BSD-2-Clause",
        "BSD-3-Clause", "MPL-2.0", "MPL-2.0 header", "Unlicense", "CC0-1.0", "CC-BY-4.0 header", "CC-BY-SA-4.0",
    ]
    texts = []
    for name in names:
        words = licences.TEMPLATES[name].split()
        texts.append("import this\n\n" + "\n".join(" * " + " ".join(words[i:i + 9]) for i in range(0, len(words), 9)) + "\n\n" + PROSE)
    got = found(docs(spark, texts))
    assert {(k, n) for k, _, _, n, d in got if d == 1.0} >= set(enumerate(names))
