import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalink.llm import language, quality, queries
from catalink.llm.samples import bounded_sample
from tests.conftest import SMALL
from tests.llm.helpers import clashing, docs


# ---- language ------------------------------------------------------------------------------------------------------------


def learned(spark):
    texts = [("en", "the cat and the dog of the house"), ("en", "this is the end of it and that"), ("de", "der hund und die katze"), ("de", "das ist das haus der katze und")]
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts * 5)], "doc_id bigint, text string, lang string")
    return language.fit(df)


def test_known_words_and_shorter_grams(spark):
    model = learned(spark)
    assert model.languages == ["de", "en"]
    scorer = language.Scorer(model)
    word = "katze"
    assert scorer.predict("katze katze")[0] == "de" and scorer.predict("THE End")[0] == "en"
    # A known word counts by its own log frequencies, an unseen one by the mean of its longest known n-grams.
    assert word in model.words and "katzen" not in model.words
    known = [model.grams[g] for g in language.grams_of("katzen", 5) if g in model.grams]
    assert known and np.allclose(scorer.unseen("katzen"), model.gram_logs[known].mean(0))
    assert scorer.predict("katzen")[0] == "de"
    assert scorer.predict("日本")[1] == pytest.approx(0.5)  # nothing known: as frequent as learned
    for words in (["the"], ["the", "haus"]):
        total = sum(model.word_logs[model.words[w]] for w in words)
        chance = np.exp(total - total.max())
        assert scorer.predict(" ".join(words))[1] == pytest.approx((chance / chance.sum()).max())


def test_the_cache_does_not_change_predictions(spark, monkeypatch):
    model = learned(spark)
    texts = ["".join(random.Random(i).choice("abcdeht ") for _ in range(80)) for i in range(60)]
    want = [language.Scorer(model).predict(t) for t in texts]
    monkeypatch.setattr(language, "CACHE_ENTRIES", 3)
    scorer = language.Scorer(model)
    assert [scorer.predict(t) for t in texts] == want


def test_counts_cover_whole_texts_and_models_repeat(spark):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice(["ab", "abc", "é", "X"]) for _ in range(draw.randint(1, 400))), draw.choice(["a", "b", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    first, again = language.fit(df), language.fit(df.repartition(5))
    assert first.words == again.words and np.array_equal(first.word_logs, again.word_logs) and np.array_equal(first.gram_logs, again.gram_logs)
    count = {x: sum(t.lower().split().count("ab") for _, t, y in rows if y == x) for x in "ab"}
    total = {x: sum(len(t.split()) for _, t, y in rows if y == x) for x in "ab"}
    assert np.allclose(np.exp(first.word_logs[first.words["ab"]]), [(count[x] + 0.5) / (total[x] + 0.5 * 4) for x in "ab"])


def test_language_of_odd_rows(spark):
    model = learned(spark)
    df = clashing(docs(spark, [None, "", "123 ²", "the", "the", "und " * 50_000]))
    got = {r["doc_id"]: tuple(r["language"]) for r in language.predict(df, model).select("doc_id", "language").collect()}
    assert [got[i][0] for i in range(6)] == ["und", "und", "und", "en", "en", "de"]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert language.fit(docs(spark, []).select("doc_id", "text", "lang")) is None
    assert language.fit(docs(spark, ["a"], lang=None)) is None
    assert [r["language"]["lang"] for r in language.predict(docs(spark, ["a"]), None).collect()] == ["und"]
    assert language.predict(docs(spark, []), model).count() == 0


def test_held_out_languages_are_found(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op2_language(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(truth)
    held = [r for r in got if r["held_out"] and truth[r["doc_id"]]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held) > 0


# ---- quality -------------------------------------------------------------------------------------------------------------


def test_newton_reaches_the_least_loss():
    draw = np.random.default_rng(3)
    good, bad = draw.normal(0.5, 1, (60, 3)), draw.normal(-0.5, 1, (40, 3))
    weights = quality.rank_pairs(good, bad, 4, 1e-2)
    fixed = np.random.default_rng(7)
    left = np.concatenate([np.repeat(np.arange(60), 4), fixed.integers(0, 60, 160)])
    right = np.concatenate([fixed.integers(0, 40, 240), np.repeat(np.arange(40), 4)])
    gap = good[left] - bad[right]

    def loss(w):
        return np.log1p(np.exp(-gap @ w)).mean() + 0.5e-2 * w @ w

    for i in range(3):
        for step in (-1e-3, 1e-3):
            moved = weights.copy()
            moved[i] += step
            assert loss(moved) > loss(weights)


def test_features_of_odd_texts():
    for text in (b"", b"   \n", b"a", b"\xff\xfe", "é".encode(), b"a " * 100_000, b"x" * 500_000):
        row = quality.features(text)
        assert len(row) == len(quality.FEATURES) and all(map(math.isfinite, row))


def test_scores_depend_on_the_text_alone_and_the_threshold_is_a_quantile(spark):
    docs_, labels = (spark.read.parquet(f"{SMALL}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.fit(docs_, labels)
    scored = quality.score(docs_, model).join(labels, "doc_id").collect()
    below = sum(r["score"] < quality.PASS_MARK for r in scored)
    assert below == sum(r["quality"] == 0 for r in scored)
    again = quality.score(clashing(docs_.select("text").withColumn("doc_id", F.lit(1)).repartition(5)), model)
    assert sorted(r["score"] for r in again.collect()) == sorted(r["score"] for r in quality.score(docs_, model).collect())
    assert quality.fit(docs_.repartition(6), labels.repartition(3)).cut == pytest.approx(model.cut, rel=1e-9)


def test_quality_without_labels_of_both_kinds(spark):
    one = docs(spark, ["a", None, "", "a"])
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, None), (None, 0)], "doc_id bigint, quality int")
    assert quality.fit(one, labels) is None
    assert [r["score"] for r in quality.score(one, None).collect()] == [quality.PASS_MARK] * 4
    assert quality.fit(one.limit(0), labels) is None


def test_held_out_quality_is_found(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [r for r in queries.op8_quality(spark, sf).collect() if r["held_out"] and truth.get(r["doc_id"]) is not None]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held) > 0


def test_samples_are_bounded_and_repeat(spark):
    df = spark.range(20_000)
    taken = bounded_sample(df, 2000, "id")
    assert 1700 < taken.count() < 2300
    assert taken.exceptAll(bounded_sample(df.repartition(9), 2000, "id")).count() == 0
    assert bounded_sample(df, 50_000, "id").count() == 20_000
