import pytest
from pyspark.sql import functions as F

from catalink.operators import documents as docs
from catalink.operators import embedding as emb


def test_unit_content(film):
    text = docs.unit_content(film).filter("table_name = 'film'").first().content
    assert text == (
        "Database: rentals\n\nSchema: public\n\nTable: film\n\nColumns:\n- film_id: integer, NOT NULL\n"
        "- title: varchar, NOT NULL, DEFAULT 'untitled'\n- note: text, NULL\n\nPrimary Keys:\n- film_id\n\nForeign Keys:\nNone\n\n"
        "Indexes:\n- film_pkey (film_id) [UNIQUE, PRIMARY]\n- film_title (title, note)"
    )
    old = docs.unit_content(film, legacy_suffix=True).filter("table_name = 'film'").first().content
    assert old.endswith("- film_pkey (film_id) [UNIQUE, PRIMARY]\n- film_title (title, note) []")
    inventory = docs.unit_content(film).filter("table_name = 'inventory'").first().content
    assert "Foreign Keys:\n- film_id → public.film.film_id\n" in inventory


def test_table_document_leaves_empty_sections_out(film):
    text = docs.table_documents(film).filter("table_name = 'inventory'").first().content
    assert text == (
        "Database: rentals\nSchema: public\nTable: inventory\n\nColumns:\n- inventory_id: integer, NOT NULL\n- film_id: integer, NOT NULL\n\n"
        "Primary Keys:\n- inventory_id\n\nForeign Keys:\n- film_id references public.film.film_id"
    )


def test_document_union(film):
    kinds = {r.doc_type: r["count"] for r in docs.all_documents(film).groupBy("doc_type").count().collect()}
    assert kinds == {"schema-summary": 1, "table": 6, "relationship": 4}
    summary = docs.summary_documents(film).first().content
    assert summary.endswith("Tables:\n- category\n- film\n- film_category\n- inventory\n- rental\n- scratch")
    relation = docs.relationship_documents(film).filter("table_name = 'rental'").first()
    assert relation.referenced_table_name == "inventory"
    assert relation.content.endswith("Relationship:\npublic.rental.inventory_id\nreferences\npublic.inventory.inventory_id")


def test_embedder_is_called_in_order_and_in_batches(spark):
    sizes_seen = spark.sparkContext.accumulator(0)

    def embedder(texts):
        sizes_seen.add(1)
        assert len(texts) <= 50
        return [[float(t), 1.0] for t in texts]

    df = spark.range(0, 240, 1, 2).select(F.col("id").cast("string").alias("text"))
    rows = emb.embed(df, "text", embedder).collect()
    assert all(r.embedding == [float(r.text), 1.0] for r in rows) and len(rows) == 240


@pytest.mark.parametrize("answer", [lambda t: [[1.0]] * (len(t) + 1), lambda t: [[]] * len(t)])
def test_embedder_answers_are_checked(spark, answer):
    df = spark.createDataFrame([("a",), ("b",)], "text string")
    with pytest.raises(Exception, match="embedder returned"):
        emb.embed(df, "text", answer).collect()


def test_blank_questions_are_set_aside(spark):
    df = spark.createDataFrame([(1, "top films"), (2, "  "), (3, None)], "question_id int, question string")
    good, bad = emb.embed_questions(df)
    assert [r.question_id for r in good.collect()] == [1]
    assert sorted(r.question_id for r in bad.collect()) == [2, 3]


def test_embedding_gate(spark):
    df = spark.createDataFrame([("a", [1.0]), ("a", []), ("b", [1.0]), ("a", None)], "k string, embedding array<float>")
    gate = {r.k: (r.units, r.missing, r.complete) for r in emb.embedding_gate(df, ["k"]).collect()}
    assert gate == {"a": (3, 2, False), "b": (1, 0, True)}
    hashed = emb.hashed_embedding(spark.createDataFrame([("x y x",), ("",), (None,)], "t string"), "t").collect()
    assert [len(r.embedding) for r in hashed] == [64, 0, 0]
    assert abs(sum(v * v for v in hashed[0].embedding) - 1) < 1e-6
