"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own, all turns before it are its context, and only
that reply is trained on.

The contexts of a conversation's examples are prefixes of one text, the conversation's formatted stream. ``format_turns`` writes the stream,
as one segment a turn with its place in the stream, and ``example_texts`` expands it: each reply with its whole context and its loss span.
The digests are read back from these examples. Only the segments are shuffled and stored, as written-out contexts grow with the square of a
conversation's length; ``examples`` gives the spans alone.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from catalink.llm.common import Scratch
from catalink.session import spread

TURN, END = "<|im_start|>", "<|im_end|>"
# Strings that chat templates use to mark turns.
CONTROL = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]")
RANGE_ROWS = 100_000  # turns of a range, on average


def _control_pattern(slashes: str) -> str:
    """Opening character, backslashes, the rest of a control string."""
    firsts, rests = {c[0] for c in CONTROL}, {c[1:] for c in CONTROL}
    if any(first in rest for first in firsts for rest in rests):
        raise ValueError("a control string may hold an opening character only at its start")
    either = "|".join(re.escape(r) for r in sorted(rests, key=len, reverse=True))
    return f"([{re.escape(''.join(sorted(firsts)))}]){slashes}({either})"


def escaped(text: Column) -> Column:
    r"""``text`` without control strings: each gets a backslash behind its first character, one more if it has some there already.

    No control string arises where an escaped text meets a mark, as their opening characters stand at their starts only.
    """
    return F.regexp_replace(text, _control_pattern(r"(\\*)"), r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _control_pattern(r"\\(\\*)"), "$1$2$3")


def _escaped_role(role: Column) -> Column:
    """A role ends with its line, so its line breaks are spelled out."""
    return escaped(F.regexp_replace(F.regexp_replace(role, r"\\", r"\\\\"), "\n", r"\\n"))


def _unescaped_role(role: Column) -> Column:
    parts = F.split(unescaped(role), r"\\\\")  # a pair of backslashes is one; what is left before an n is a line break
    return F.array_join(F.transform(parts, lambda p: F.regexp_replace(p, r"\\n", "\n")), "\\")


def format_turns(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant"
) -> DataFrame:
    """(conversation, position, segment, start, example, loss_start, loss_end): one row per turn, in any order.

    ``segment`` is the turn between its marks, ``start`` its place in the conversation's stream, which is made of the segments by
    position (from 0). ``example`` is the number (from 0) of the example whose context or reply the turn joins: the reply, a turn of the
    role ``trained``, closes its example. ``loss_start`` and ``loss_end`` are the reply's span in the stream, without marks; null for
    other turns. All places count code points.

    Turns are ordered by ``turn`` (null first), ties by role and text; repeated rows are turns of their own. Null texts and roles are
    empty; rows without conversation are one conversation. An empty table gives an empty result, extra columns are ignored. A conversation
    of any length is cut into ranges of about RANGE_ROWS turns which are numbered apart; only the first row of a range can continue a
    conversation, so the sums that ranges add to each other are as many as ranges.
    """
    scratch = Scratch(df.sparkSession)
    role_of, text_of = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    turns = df.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), role_of.alias("role"), text_of.alias("text"))
    head = F.concat(F.lit(TURN), _escaped_role(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    segments = spread(turns).select(
        "conv", "turn", "role", F.xxhash64("text").alias("tie"), F.concat(head, body, F.lit(END + "\n")).alias("segment"),
        F.length(head).alias("head"), F.length(body).alias("body"), (F.col("role") == trained).alias("reply"),
    )
    ranges = max(1, -(-df.count() // RANGE_ROWS))
    ranged = segments.repartitionByRange(ranges, "conv", "turn", "role", "tie").withColumn("range", F.spark_partition_id())
    ranged = scratch.write(ranged, "turns")

    order = Window.partitionBy("range", "conv").orderBy("turn", "role", "tie", "segment")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    length, replies = F.length("segment").cast("long"), F.col("reply").cast("long")
    local = ranged.withColumn("at", F.row_number().over(order).cast("long") - 1)
    local = local.withColumn("chars", F.coalesce(F.sum(length).over(before), F.lit(0))).withColumn("no", F.coalesce(F.sum(replies).over(before), F.lit(0)))
    sums = ranged.groupBy("range", "conv").agg(F.count("*").alias("turns"), F.sum(length).alias("chars"), F.sum(replies).alias("replies"))
    past = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("range", "conv", *(F.sum(c).over(past).alias(f"past_{c}") for c in ("turns", "chars", "replies")))
    carried = carried.filter("past_turns IS NOT NULL").withColumnRenamed("range", "in_range").withColumnRenamed("conv", "of")  # one for each range at most
    joined = local.join(F.broadcast(carried), (F.col("range") == F.col("in_range")) & F.col("conv").eqNullSafe(F.col("of")), "left")
    start = F.col("chars") + F.coalesce("past_chars", F.lit(0))
    loss = start + F.col("head")
    out = joined.select(
        F.col("conv").alias(conversation),
        (F.col("at") + F.coalesce("past_turns", F.lit(0))).alias("position"),
        "segment",
        start.alias("start"),
        (F.col("no") + F.coalesce("past_replies", F.lit(0))).alias("example"),
        F.when(F.col("reply"), loss).alias("loss_start"),
        F.when(F.col("reply"), loss + F.col("body")).alias("loss_end"),
    )
    out = scratch.write(out, "chat")
    scratch.drop(ranged)
    return out


def examples(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, example, position, n_chars, loss_start, loss_end): one row per assistant turn of ``format_turns``.

    The example's text is the stream up to ``n_chars``: all turns before the one at ``position`` and that reply with its marks. Only
    the span from ``loss_start`` to ``loss_end`` is trained on. Turns behind the last reply are in no example. No shuffle.
    """
    end = F.col("start") + F.length("segment")
    return formatted.filter("loss_start IS NOT NULL").select(conversation, "example", "position", end.alias("n_chars"), "loss_start", "loss_end")


def example_texts(formatted: DataFrame, conversation: str = "conv_id", rest: bool = False) -> DataFrame:
    """(conversation, example, position, n_chars, loss_start, loss_end, text): ``examples`` with their texts written out, the reply behind
    all turns before it; as much output as the squares of the conversations' lengths.

    With ``rest``, a conversation that does not end with a reply has one more row, its whole stream without a loss span.
    """
    order = Window.partitionBy(conversation).orderBy("position")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    written = formatted.withColumn("text", F.array_join(F.collect_list("segment").over(upto), ""))
    kept = F.col("loss_start").isNotNull()
    if rest:
        written = written.withColumn("last", F.lead("position").over(order).isNull())
        kept = kept | F.col("last")
    keep = (conversation, "example", "position", F.length("text").cast("long").alias("n_chars"), "loss_start", "loss_end", "text")
    return written.filter(kept).select(*keep)


def turns_of(text: Column) -> Column:
    """The turns of an example's text, read from its marks: an array of (role, text)."""
    segments = F.filter(F.split(text, re.escape(TURN)), lambda s: s != "")  # escaped texts hold no mark

    def turn(segment: Column) -> Column:
        line = F.instr(segment, "\n")
        body = F.substring(segment, line + 1, F.length(segment) - line - F.lit(len(END) + 1))
        return F.struct(_unescaped_role(F.substring(segment, F.lit(1), line - 1)).alias("role"), unescaped(body).alias("text"))

    return F.transform(segments, turn)


def loss_text(text: Column) -> Column:
    """What the loss span of an example's text covers, unescaped; null without a span."""
    return unescaped(F.substring(text, F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))


def digests(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What the written examples hold of each conversation, read back from them: numbers and digests of its turns and trained texts.

    The trained texts are those under the spans of its examples, the turns are those of its longest text, which holds all contexts.
    A digest covers a conversation as a whole, so its examples are written and meet in one task.
    """
    written = example_texts(formatted, conversation, rest=True)
    trained, chars = F.col("loss_start").isNotNull(), F.col("n_chars")
    back = written.select(conversation, "position", chars, trained.alias("trained"), loss_text(F.col("text")).alias("loss"), "text")
    longest = F.lead("position").over(Window.partitionBy(conversation).orderBy("position")).isNull()
    back = back.withColumn("stream", F.when(longest, F.col("text"))).drop("text")
    grouped = back.groupBy(conversation).agg(
        F.max("stream").alias("stream"),
        F.array_sort(F.collect_list(F.when(F.col("trained"), F.struct("position", "loss")))).alias("losses"),
        F.max("n_chars").alias("formatted_chars"),
        F.count_if("trained").alias("n_examples"),
        F.coalesce(F.sum(F.when(F.col("trained"), chars)), F.lit(0)).alias("example_chars"),
    )
    read = grouped.withColumn("turns", turns_of(F.col("stream"))).withColumn("loss", F.array_join(F.transform("losses", lambda x: x["loss"]), ""))
    return read.select(
        conversation,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
        "example_chars",
    )


# The digests of op13_chat in DuckDB.
ORACLE = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (CAST(-7 AS BIGINT), CAST(0 AS BIGINT), 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), sized AS (
  SELECT *, role = 'assistant' AS reply,
    12 + 1 + 10 + 1 + length(role) + length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|s>|/s>|INST\]|/INST\])', '\1.\2\3', 'g')) AS chars
  FROM rows_
), placed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS end_ FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (reply), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (reply), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (reply) AS n_examples, CAST(coalesce(sum(end_) FILTER (reply), 0) AS BIGINT) AS example_chars
FROM placed GROUP BY conv_id
"""
