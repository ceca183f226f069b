from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs(spark, texts, source="s", lang="en", ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The same rows with extra columns named like those that operators use inside."""
    for name in ("key", "value", "n", "size", "text_id", "spans", "set_id", "fold", "part", "rank", "label", "url_"):
        df = df.withColumn(name, F.lit("other"))
    return df


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
