"""Near duplicates by bottom-k sketches from one hash function.

A document's set holds the 64-bit hashes of its distinct word shingles; its sketch is the k smallest of them. Inverted lists of retained
values generate the overlaps, the sketch of the union estimates the similarity, and the full sets confirm every link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalink.llm.common import Scratch, text_bytes
from catalink.llm.graphs import components

SKETCH = 32
MISS = 1e-9  # chance at which the estimate may lose a pair just at the threshold
CACHE_ENTRIES = 200_000
PART = 2_000_000  # values of full sets that one task counts
BLOCK = 20_000  # values of full sets in a block of nodes compared at once
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
ODD = np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX[1]
    x = (x ^ (x >> np.uint64(29))) * MIX[2]
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Sorted distinct shingle hashes of texts; remembers the hashes of words."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # of bytes: only A-Z change, and only the six ASCII spaces separate
        if not words:
            return np.zeros(0, np.int64)
        known = self.known
        found = list(map(known.get, words))
        if None in found:
            if len(known) > CACHE_ENTRIES:
                known.clear()
            for i, hit in enumerate(found):
                if hit is None:
                    hit = known.get(words[i])
                    if hit is None:
                        hit = known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
                    found[i] = hit
        hashes = np.array(found, np.uint64)
        width = min(self.width, len(hashes))
        n = len(hashes) - width + 1
        total = np.full(n, width, np.uint64)
        for i in range(width):
            total = _mixed(total * ODD + hashes[i : i + n])
        return np.unique(total.view(np.int64))


def _sets(text: Column, width: int, keep: int | None) -> Column:
    """struct(n, set_id, values) of a text; the ``keep`` smallest values or all. Equal sets have equal ids."""

    @F.arrow_udf("struct<n: bigint, set_id: binary, values: array<bigint>>")
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        shingles = Shingler(width)
        for batch in batches:
            found = [shingles(t) for t in text_bytes(batch)]
            kept = [x[:keep] for x in found]
            ends = np.cumsum([0, *map(len, kept)]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*kept, np.zeros(0, np.int64)])))
            ids = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary())
            yield pa.StructArray.from_arrays([pa.array([len(x) for x in found], pa.int64()), ids, values], ["n", "set_id", "values"])

    return made(text)


def least_overlap(percent: int, size: int = SKETCH) -> int:
    """Values of a union sketch that two sets of the threshold similarity share but with a chance of MISS."""
    p, chance = percent / 100, 0.0
    for shared in range(size + 1):
        chance += math.comb(size, shared) * p**shared * (1 - p) ** (size - shared)
        if chance > MISS:
            return max(1, shared)
    return size


def _both(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b) with the column of both nodes as a_<column>, b_<column>; hub nodes are split by adaptive execution."""
    for side in ("b", "a"):
        pairs = pairs.join(table.select(F.col("set_id").alias(side), F.col(column).alias(f"{side}_{column}")), side)
    return pairs


def _confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The linked pairs: sketches estimate, full sets decide."""
    limit = least_overlap(percent)
    pairs = pairs.filter(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")
    seen = _both(pairs.select("a", "b", "a_n", "b_n"), nodes, "sketch")
    union = F.slice(F.array_sort(F.array_union("a_sketch", "b_sketch")), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect("a_sketch", "b_sketch"), union))
    # A sketch that is a whole set is not an estimate: the limit for it is exact.
    whole = F.greatest("a_n", "b_n") <= SKETCH
    likely = F.when(whole, 100 * shared >= percent * F.size(F.array_union("a_sketch", "b_sketch"))).otherwise(shared >= limit)
    likely = scratch.write(seen.filter(likely).select("a", "b", "a_n", "b_n"), "likely")
    full = _both(likely, sets, "values")
    common = F.size(F.array_intersect("a_values", "b_values"))
    links = scratch.write(full.filter(100 * common >= percent * (F.col("a_n") + F.col("b_n") - common)).select("a", "b"), "links")
    scratch.drop(likely)
    return links


def _shared_counts(sets: DataFrame) -> DataFrame:
    """(set_id, shared): how many values of each full set any other set of the table has.

    The range of hash values is cut into as many equal parts as bound a part's values to about PART; a task counts one part.
    """
    total = sets.agg(F.sum(F.size("values"))).first()[0] or 0
    parts = max(1, math.ceil(total / PART))
    borders = np.array([-(1 << 63) + (1 << 64) * i // parts for i in range(1, parts)], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for set_id, values in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = np.asarray(values.values)
                ends = [0, *np.searchsorted(values, borders).tolist(), len(values)]
                out += [(part, set_id, values[a:b]) for part, (a, b) in enumerate(zip(ends, ends[1:])) if a < b]
            columns = list(zip(*out)) or [[]] * 3
            kinds = (pa.int32(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["part", "set_id", "values"])

    def count(table: pa.Table) -> pa.Table:
        lists = table.column("values").combine_chunks()
        flat, ends = np.asarray(lists.flatten()), np.cumsum([0, *(len(x) for x in lists)])
        _, place, uses = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.add.reduceat((uses[place] > 1).astype(np.int64), ends[:-1])
        return pa.table({"set_id": table.column("set_id"), "shared": pa.array(shared)})

    dealt = sets.select("set_id", "values").mapInArrow(deal, "part int, set_id binary, values array<bigint>")
    counted = dealt.groupBy("part").applyInArrow(count, "set_id binary, shared bigint")
    return counted.groupBy("set_id").agg(F.sum("shared").alias("shared"))


def _inverted_lists(nodes: DataFrame, percent: int) -> DataFrame:
    """(value, set_id, n, weight): the nodes with each of the first few retained values, rare ones first, that several nodes have."""
    limit = least_overlap(percent)
    exact = F.ceil(F.col("n") * percent / 100.0).cast("int")
    # Sets whose partners all have whole sketches as well must share as many values as their similarity says.
    needed = F.when(F.col("n") * 100 <= SKETCH * percent, exact).otherwise(F.least(F.lit(limit), F.col("n").cast("int")))
    held = nodes.select("set_id", "n", (F.size("sketch") - needed + 1).alias("slots"), F.size("sketch").alias("kept"), F.explode("sketch").alias("value"))
    common = held.groupBy("value").agg(F.count("*").alias("uses")).filter("uses > 1")
    ranked = held.join(common, "value").groupBy("set_id", "n", "slots", "kept").agg(
        F.array_sort(F.collect_list(F.struct("uses", "value"))).alias("shared"), F.sum("uses").alias("weight")
    )
    # Values of this node alone take the first slots.
    slots = F.col("slots") - (F.col("kept") - F.size("shared"))
    listed = ranked.filter(slots > 0).select("set_id", "n", "weight", F.explode(F.slice("shared", 1, slots)).alias("v"))
    return listed.select(F.col("v.value").alias("value"), "set_id", "n", "weight")


def _block_links(percent: int):
    """From rows of (probe, offered) lists of struct<set_id, root, values>: for each probe one link to each other component it touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for row in range(batch.num_rows):
                sides = []
                for column in batch.columns:
                    nodes = column[row].values
                    lists = nodes.field("values").slice(0)
                    flat, ends = np.asarray(lists.flatten()), np.cumsum([0, *(len(x) for x in lists)])
                    sides.append((nodes.field("set_id").to_pylist(), nodes.field("root").to_pylist(), flat, ends))
                (ids, roots, x, x_ends), (other_ids, other_roots, y, y_ends) = sides
                both = np.intersect1d(x, y)

                def table(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
                    owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
                    place = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
                    hit = both[place] == flat if len(both) else np.zeros(len(flat), bool)
                    made = np.zeros((len(ends) - 1, len(both)), np.float32)
                    made[owner[hit], place[hit]] = 1
                    return made

                common = table(x, x_ends) @ table(y, y_ends).T  # exact: counts are far below 2 ** 24
                sizes = np.diff(x_ends)[:, None] + np.diff(y_ends)[None, :]
                names = {r: i for i, r in enumerate(dict.fromkeys(roots + other_roots))}
                mine, theirs = np.array([names[r] for r in roots]), np.array([names[r] for r in other_roots])
                i, j = np.nonzero((100 * common >= percent * (sizes - common)) & (mine[:, None] != theirs[None, :]))
                _, one = np.unique(i * len(names) + theirs[j], return_index=True)
                out += [(ids[a], other_ids[b]) for a, b in zip(i[one].tolist(), j[one].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.binary()) for k in (0, 1)], ["a", "b"])

    return run


def _open_links(kept: DataFrame, leaders: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between nodes of different components that have a list in common.

    Nodes with a list in common have met its leader. Around each leader, the nodes outside its largest component are compared with all
    others of a fitting size, in blocks of nodes with about BLOCK values together: exactly, on full sets. Of a node's links one for each
    component it touches is enough, so no more rows are made than nodes and components call for.
    """
    met = kept.join(leaders, "value").select(F.col("top.set_id").alias("leader"), "set_id", "n").distinct()
    met = met.join(roots, met["set_id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "set_id")).drop("node")
    per_root = met.groupBy("leader", "root").agg(F.count("*").alias("members"))
    main = per_root.groupBy("leader").agg(F.max(F.struct("members", "root")).alias("m"), F.count("*").alias("roots")).filter("roots > 1")
    rows = met.join(main.select("leader", F.col("m.root").alias("main")), "leader")
    rows = scratch.write(rows.withColumn("class", F.floor(F.log(F.col("n").cast("double")) * 50).cast("int")), "open")
    spread = math.ceil(math.log(100 / percent) * 50) + 1

    def blocks(nodes: DataFrame, name: str) -> DataFrame:
        counts = nodes.groupBy("leader", "class").agg(F.ceil(F.sum(F.greatest("n", F.lit(100))) / BLOCK).alias("parts"))  # few nodes, if small
        dealt = nodes.join(counts, ["leader", "class"]).withColumn("part", F.pmod(F.xxhash64("set_id"), F.col("parts")))
        packed = dealt.join(sets, "set_id").groupBy("leader", "class", "part")
        return packed.agg(F.collect_list(F.struct("set_id", "root", "values")).alias(name))

    seeking = blocks(rows.filter("root <> main"), "probe").withColumn("near", F.explode(F.sequence(F.col("class") - spread, F.col("class") + spread)))
    offered = blocks(rows, "offered").select("leader", F.col("class").alias("near"), "offered")
    pairs = seeking.join(offered, ["leader", "near"]).select("probe", "offered")
    links = scratch.write(pairs.mapInArrow(_block_links(percent), "a binary, b binary").distinct(), "links")
    scratch.drop(rows)
    return links


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept) for each row: its class among rows linked by a Jaccard similarity of ``percent`` or more.

    A-Z are lower-cased, words lie between ASCII spaces, a set holds the distinct runs of ``shingle_words`` words, or the whole sequence
    of fewer words. Null or blank texts have an empty set and are linked with nothing, their component being their own key. component_id
    is the smallest key reachable, kept whether it is the row's own. Rows of equal sets are linked, so repeated rows share a component and
    all rows of the smallest key are kept. Null keys take part but are no component id unless all of a component's are null (then kept).
    An empty table gives an empty result; extra columns are ignored.

    Rows with equal sets count as one node. Retained values that several nodes share are ordered from rare to frequent over the whole
    corpus; two linked sets share one of the first few, as they have ``least_overlap`` retained values in common, but with a chance of
    MISS. Nodes of such lists whose full sets share too few values with all others together are linked with none. In each list all are
    compared with one leader, the node whose values are most common; then those are compared which are not yet in one component, see
    ``_open_links``. No pair is left out for the length of a list.
    """
    scratch = Scratch(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    rows = scratch.write(rows.select("key", _sets(F.col("text"), shingle_words, SKETCH).alias("s")).select("key", "s.*"), "sketches")
    # Equal sets have equal sketches.
    nodes = rows.filter("n > 0").groupBy("set_id", "n").agg(F.min("key").alias("low"), F.max("values").alias("sketch"))
    nodes = scratch.write(nodes, "nodes")
    rows_again = scratch.write(rows.select("key", "n", "set_id"), "rows")
    scratch.drop(rows)
    lists = scratch.write(_inverted_lists(nodes, percent), "lists")

    members = scratch.write(lists.select("set_id").distinct(), "members")
    lows = nodes.join(members, "set_id", "left_semi").select(F.col("low").alias("listed")).distinct()
    texts = df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    texts = texts.join(lows, F.col("listed").eqNullSafe(F.col("key")), "left_semi")
    sets = texts.select(_sets(F.col("text"), shingle_words, None).alias("s")).select("s.set_id", "s.values")
    all_sets = scratch.write(sets.join(members, "set_id", "left_semi").dropDuplicates(["set_id"]), "sets")
    scratch.drop(members)
    # A node can be linked only if others have as many of its values as the threshold asks for.
    able = scratch.write(_shared_counts(all_sets), "shared")
    kept = lists.join(able, "set_id").filter(f"100 * shared >= {percent} * n").drop("shared")
    kept = scratch.write(kept, "able")
    sets = scratch.write(all_sets.join(kept.select("set_id").distinct(), "set_id", "left_semi"), "able_sets")
    scratch.drop(lists, able, all_sets)

    leaders = kept.groupBy("value").agg(F.max(F.struct("weight", "set_id", "n")).alias("top"), F.count("*").alias("members"))
    leaders = scratch.write(leaders.filter("members > 1").select("value", "top"), "leaders")
    first = kept.join(leaders, "value").filter("set_id <> top.set_id")
    first = first.select(F.col("top.set_id").alias("a"), F.col("set_id").alias("b"), F.col("top.n").alias("a_n"), F.col("n").alias("b_n"))
    first = scratch.write(first.distinct(), "pairs")
    links = _confirmed(first, nodes, sets, percent, scratch)
    scratch.drop(first)
    roots = scratch.write(components(links, scratch), "roots")
    more = _open_links(kept, leaders, roots, sets, percent, scratch)
    roots = scratch.write(components(links.unionByName(more), scratch), "roots")

    grouped = nodes.join(roots, nodes["set_id"] == roots["node"], "left").select("set_id", "low", F.coalesce("root", "set_id").alias("root"))
    least = grouped.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = grouped.join(least, "root").select("set_id", "component_id")
    out = rows_again.join(labels, "set_id", "left")
    component = F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component_id"))
    out = out.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("key")).alias("kept")
    )
    out = scratch.write(out, "classes")
    scratch.drop(*[t for _, t in list(scratch.paths.values()) if t is not out])
    return out
