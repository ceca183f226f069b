import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from catalink.llm import quality, queries
from tests.conftest import SMALL
from tests.llm import test_near_duplicates, test_repeats
from tests.llm.helpers import clashing, docs
from tests.llm.test_mixing import goals


def by_name(name):
    return dict(corpus_pipeline.STAGES)[name]


def table(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_stages_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "MinHash near-dedup", "suffix-array dedup", "mixing sources to target weights", "SentencePiece encoding and decoding",
    ]
    registered = __spark_entry__.queries()
    assert registered["pipeline"] is corpus_pipeline.run
    for n in range(1, 14):
        assert sum(k.startswith(f"op{n}_") for k in registered) == 1
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_quality_stage_drops_what_it_rejects(spark):
    df = clashing(table(spark))
    model = quality.fit(df, spark.read.parquet(f"{SMALL}/labels.parquet"))
    kept = by_name("quality classifier")(spark, df, SMALL)
    want = {r["doc_id"] for r in quality.score(df, model).collect() if r["score"] >= quality.PASS_MARK}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == list(corpus_pipeline.COLUMNS)
    assert 0 < len(want) < df.count()


def test_near_dedup_stage_keeps_one_of_each_group(spark):
    df = table(spark)
    kept = by_name("MinHash near-dedup")(spark, clashing(df), SMALL)
    want = {k for k, _, _, own in test_near_duplicates.brute(pairs(df), 5, 80) if own}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want) and kept.columns == list(corpus_pipeline.COLUMNS)


def test_near_dedup_of_repeated_and_unnamed_rows(spark):
    text = "one two three four five six seven"
    df = docs(spark, [text, text, text, "another text of six words", None, None, "", "unnamed text", "unnamed text"], ids=[3, 3, 5, 7, 8, 8, 9, None, None])
    kept = by_name("MinHash near-dedup")(spark, df, SMALL)
    assert sorted(map(str, pairs(kept))) == sorted(map(str, [(3, text), (7, "another text of six words"), (8, None), (9, ""), (None, "unnamed text")]))


def test_near_dedup_of_one_id_with_several_texts(spark):
    for base in ("alpha beta gamma delta epsilon zeta", "lorem ipsum dolor sit amet consectetur", "one two three four five six", "x y z x y z w v"):
        x, y = base + " only here", " ".join(reversed(base.split())) + " in three rows"
        kept = pairs(by_name("MinHash near-dedup")(spark, docs(spark, [x, y, y, y], ids=[1, 1, 2, 3]), SMALL))
        assert sorted(kept) == sorted([(1, x), (1, y)])
        kept = pairs(by_name("MinHash near-dedup")(spark, docs(spark, [x, y, y, x, x], ids=[1, 1, None, 0, 0]), SMALL))
        assert sorted(kept) == sorted([(0, x), (1, y)])


def test_repeat_stage_equals_brute_force(spark):
    df = table(spark)
    out = by_name("suffix-array dedup")(spark, clashing(df), SMALL).orderBy("doc_id").collect()
    rows = sorted(pairs(df))
    for row, (_, text), (_, _, spans, _) in zip(out, rows, test_repeats.brute([t for _, t in rows], 200)):
        kept, at = [], 0
        for c in text:
            end = at + len(c.encode())
            if not any(a <= at and end <= b for a, b in spans):
                kept.append(c)
            at = end
        assert row["text"] == "".join(kept) and row["n_chars"] == len(kept)


def test_mix_stage_comes_near_its_targets(spark):
    df = table(spark)
    taken = by_name("mixing sources to target weights")(spark, clashing(df), SMALL)
    assert taken.columns == list(corpus_pipeline.COLUMNS)

    def sizes(rows):
        out = {}
        for r in rows:
            out[r["source"]] = out.get(r["source"], 0) + len((r["text"] or "").split())
        return out

    before, after = sizes(df.collect()), sizes(taken.collect())
    longest = max(len((r["text"] or "").split()) for r in df.collect())
    assert all(abs(after.get(s, 0) - t) <= longest for s, t in goals(before).items())
    assert taken.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_token_stage_equals_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.MODEL)
    df = table(spark)
    got = {r["doc_id"]: r for r in by_name("SentencePiece encoding and decoding")(spark, df, SMALL).collect()}
    for key, text in pairs(df):
        assert got[key]["ids"] == library.encode(text or "") and got[key]["n_tokens"] == len(got[key]["ids"])


def test_run_and_an_empty_table(spark, tmp_path):
    done = corpus_pipeline.run(spark, SMALL)
    assert done.count() > 0 and "ids" in done.columns
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
