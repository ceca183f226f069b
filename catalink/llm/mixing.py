"""Mixing sources to target weights by pivotal rounding of fractional copy numbers; DataFrame and SQL functions only.

Each document of a source should be taken target / source size times on average. The whole part is certain. The fractional parts are
rounded in pairs: words are moved from one document to the other, in a random direction whose odds keep both expectations, until one of
the two is taken as a whole or not at all. A task rounds a bounded group in this way and passes on the one document that is left; the
documents left over by all groups form the groups of the next level, up to a single one for each source. So a source's taken words miss
its target by less than its last document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalink.llm.common import WORDS, Scratch

GROUP = 64  # documents rounded together, on average
ITEM = "struct<key: bigint, size: bigint, rows: bigint, sure: bigint, p: double, up: int>"


def word_count(text: Column) -> Column:
    """Number of words between ASCII spaces; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sizes`` (source, source_size) with ``target``: the weights repeat over the sources by code point, null last.

    The targets share ``share`` times all sizes by weight; a source stops at ``most`` times its size, and what it leaves is shared again
    by weight until none is above. In closed form: all targets are the same multiple of their weight but for the stopped ones, which have
    the least bounds for their weight. One small row per source is sorted by a single task. Nothing but zeros for an all-empty table.
    """
    if share > most:
        raise ValueError("the shares cannot exceed what all sources may give")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("weight", F.element_at(cycle, (turn % len(weights) + 1).cast("int")))
    rows = rows.withColumn("bound", most * F.col("source_size")).withColumn("ratio", F.col("bound") / F.col("weight"))
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    given = F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", given / open_weight)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(everything)["level"]
    return rows.withColumn("target", F.least("bound", F.coalesce(level, F.lit(0.0)) * F.col("weight"))).select("source", "source_size", "target")


def _draw(level: int, *keys: str) -> str:
    return f"(pmod(xxhash64('mix', {level}, {', '.join(keys)}), 9007199254740992L) / 9007199254740992.0D)"


def _round_group(level: int) -> Column:
    """Of sorted ``items``: struct(rest, done), the one item that is still fractional, or null, and the rounded ones."""

    def item(name: str, p: str) -> str:
        return f"named_struct('key', {name}.key, 'size', {name}.size, 'rows', {name}.rows, 'sure', {name}.sure, 'p', {p}, 'up', CAST(round({p}) AS INT))"

    # Words that a can take up and b give away, and the other way round; the odds keep the expected words of both.
    odds = (
        "named_struct('a', acc.rest, 'b', x, 'done', acc.done, 'ab', least(acc.rest.size * (1 - acc.rest.p), x.size * x.p), "
        "'ba', least(acc.rest.size * acc.rest.p, x.size * (1 - x.p)))"
    )
    moved = (
        "named_struct('a', t.a, 'b', t.b, 'done', t.done, "
        "'pa', IF(t.up, IF(t.a.size * (1 - t.a.p) <= t.b.size * t.b.p, 1D, t.a.p + t.ab / t.a.size), "
        "IF(t.a.size * t.a.p <= t.b.size * (1 - t.b.p), 0D, t.a.p - t.ba / t.a.size)), "
        "'pb', IF(t.up, IF(t.b.size * t.b.p <= t.a.size * (1 - t.a.p), 0D, t.b.p - t.ab / t.b.size), "
        "IF(t.b.size * (1 - t.b.p) <= t.a.size * t.a.p, 1D, t.b.p + t.ba / t.b.size)))"
    )
    drawn = f"named_struct('a', o.a, 'b', o.b, 'done', o.done, 'ab', o.ab, 'ba', o.ba, 'up', {_draw(level, 'o.b.key', 'o.b.size', 'o.a.key')} * (o.ab + o.ba) < o.ba)"
    whole = "(m.{0} < 1e-9 OR m.{0} > 1 - 1e-9)"
    settled = (
        f"named_struct('rest', CASE WHEN NOT {whole.format('pa')} THEN {item('m.a', 'm.pa')} WHEN NOT {whole.format('pb')} THEN {item('m.b', 'm.pb')} END, "
        f"'done', concat(m.done, IF({whole.format('pa')}, array({item('m.a', 'm.pa')}), array()), "
        f"IF({whole.format('pb')}, array({item('m.b', 'm.pb')}), array())))"
    )
    step = f"transform(transform(transform(array({odds}), o -> {drawn}), t -> {moved}), m -> {settled})[0]"
    start = f"named_struct('rest', CAST(NULL AS {ITEM}), 'done', CAST(array() AS array<{ITEM}>))"
    return F.expr(f"aggregate(items, {start}, (acc, x) -> IF(acc.rest IS NULL, named_struct('rest', x, 'done', acc.done), {step}))")


def mix(
    df: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size",
    weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """(key, size, source, source_size, target, copies) for each row: how often the mix takes it, 0 up to ceil(most) times.

    Null sizes are 0; documents without words are taken the certain whole part of times. Null keys and sources are ordinary values.
    Rows that agree in key, source and size are rounded as one, by their number, so repeated rows need no single group. Reruns agree: all
    draws are hashes of keys and sizes. An empty table gives an empty result; extra columns are ignored.
    """
    scratch = Scratch(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(source).alias("source"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    classes = scratch.write(rows.groupBy("source", "key", "size").agg(F.count("*").alias("rows")), "classes")
    per_source = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count("*").alias("n"))
    goals = targets(per_source.select("source", "source_size"), weights, share, most).withColumnRenamed("source", "s")
    goals = per_source.join(goals.drop("source_size"), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goals = scratch.write(goals.withColumn("ratio", ratio).withColumnRenamed("source", "s"), "targets")

    with_ratio = classes.join(goals.select("s", "ratio", "n"), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    part = F.when((F.col("size") > 0), F.col("rows") * (F.col("ratio") - F.floor("ratio"))).otherwise(0.0)
    part = F.when(F.abs(part - F.round(part)) < 1e-9, F.round(part)).otherwise(part)
    items = with_ratio.withColumn("part", part).select(
        "source", "n", F.struct(
            "key", "size", "rows", F.floor("part").alias("sure"), (F.col("part") - F.floor("part")).alias("p"), F.lit(0).alias("up")
        ).cast(ITEM).alias("item"),
    )
    done = [items.filter("item.p = 0").select("source", "item")]
    open_items = items.filter("item.p > 0")
    most_rows = per_source.agg(F.max("n")).first()[0] or 0
    level, width = 0, GROUP
    while True:
        last = width >= most_rows  # every source is a single group
        groups = F.lit(1) if last else F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(width)))
        chosen = open_items.withColumn("g", F.pmod(F.xxhash64(F.lit("group"), F.lit(level), "item.key", "item.size"), groups))
        order = F.array_sort(F.collect_list(F.struct(F.xxhash64(F.lit(level), "item.key", "item.size").alias("o"), "item")))
        packed = chosen.groupBy("source", "g").agg(F.transform(order, lambda z: z["item"]).alias("items"), F.first("n").alias("n"))
        rounded = scratch.write(packed.select("source", "n", _round_group(level).alias("r")), f"level{level}")
        done.append(rounded.select("source", F.explode("r.done").alias("item")))
        open_items = rounded.filter("r.rest IS NOT NULL").select("source", "n", F.col("r.rest").alias("item"))
        if last:
            break
        level, width = level + 1, width * GROUP
    # The last document of a source falls by its own odds.
    up = F.expr(f"IF({_draw(-1, 'item.key', 'item.size')} < item.p, 1, 0)")
    done.append(open_items.select("source", F.col("item").withField("up", up).alias("item")))
    everything = done[0]
    for more in done[1:]:
        everything = everything.unionByName(more)
    out = everything.select("source", "item.*").join(goals, F.col("s").eqNullSafe(F.col("source")))
    turn = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    out = out.select("key", "size", "source", "source_size", "target", "ratio", (F.col("sure") + F.col("up")).alias("extra"), turn.alias("turn"))
    copies = (F.floor("ratio") + (F.col("turn") <= F.col("extra")).cast("long")).alias("copies")
    out = scratch.write(out.select("key", "size", "source", "source_size", "target", copies), "mix")
    scratch.drop(classes, goals, *[t for p, t in list(scratch.paths.values()) if t is not out and t is not classes and t is not goals])
    return out.withColumnsRenamed({"key": key, "source": source, "size": size})


def take(df: DataFrame, source: str = "source", text: str = "text", key: str = "doc_id", **parameters) -> DataFrame:
    """The rows of ``df`` as often as the mix takes them, sizes being the words of ``text``; parameters as for ``mix``."""
    sized = df.withColumn("__size", word_count(F.col(text)))
    mixed = mix(sized.select(key, source, "__size"), key, source, "__size", **parameters)
    classes = mixed.groupBy(key, source, "__size").agg(F.sum("copies").alias("__total"), F.count("*").alias("__rows"))
    classes = classes.withColumnsRenamed({key: "__k", source: "__s", "__size": "__n"})
    same = F.col("__k").eqNullSafe(F.col(key)) & F.col("__s").eqNullSafe(F.col(source)) & (F.col("__n") == F.col("__size"))
    joined = sized.join(classes, same)
    # Rows that agree in key, source and size share their copies, by a hash of the text.
    turn = F.row_number().over(Window.partitionBy("__k", "__s", "__n").orderBy(F.xxhash64(text)))
    each = F.floor(F.col("__total") / F.col("__rows"))
    copies = each + (turn <= F.col("__total") - each * F.col("__rows")).cast("long")
    repeated = joined.withColumn("__copies", copies.cast("int"))
    return repeated.select(*df.columns, F.explode(F.array_repeat(F.lit(1), F.col("__copies"))).alias("__one")).drop("__one")
