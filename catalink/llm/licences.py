"""Licence scan: lines, paragraphs, whole texts and runs of words compared with licence templates by the Dice coefficient of their word bigrams.

DataFrame functions only and no shuffle. An inverted list of template bigrams finds the documents in which any template is possible; only
their units and runs are looked at. Units whose number of words no template admits are dropped before their bigrams are made, and
runs are looked for only in documents that share as many bigrams with a template as a run must.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT = 400  # bigrams of templates that are looked for in one go
WORD = r"[\p{L}\p{N}]+"

# Short notices, two short licences, and the normalised texts and standard headers of common licences.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "All rights reserved": "All rights reserved.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT "
        "SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM "
        "LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included "
        "in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS "
        "OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF "
        "CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
} | json.loads(Path(__file__).with_name("licence_texts.json").read_text())


def template_bigrams(text: str) -> list[str]:
    """Distinct bigrams of the lower-cased words, in code point order; the word itself for a single one."""
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({" ".join(p) for p in zip(words, words[1:])} or set(words))


def bounds(size: int, percent: int) -> tuple[int, int]:
    """Least and greatest number of distinct bigrams of a unit whose Dice coefficient with ``size`` bigrams can reach the threshold."""
    return -(-percent * size // (200 - percent)), (200 - percent) * size // percent


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used; null for a null value."""
    return F.get(F.transform(F.array(value), lambda v: F.when(v.isNotNull(), body(v))), F.lit(0))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"))


def _pairs(words: Column) -> Column:
    """The bigrams of a list of words, one for each place."""
    return F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)
    )


def bigrams(text: Column) -> Column:
    """The distinct bigrams of a normalised unit."""
    words = _words(text)
    return F.array_distinct(F.when(F.size(words) > 1, _pairs(words)).otherwise(words))


def _constant(words: list[str]) -> Column:
    return F.split(F.lit("\n".join(words)), "\n")  # one literal, however many words


def _best(own: Column, sets: dict[str, list[str]], percent: int) -> Column:
    """struct<d, licence> of the template most like a set of bigrams, d being the negative Dice coefficient; null below the threshold."""
    scored = [F.lit(None).cast("struct<d: double, licence: string>")] * 2
    for name, words in sets.items():
        low, high = bounds(len(words), percent)
        shared = F.when(F.size(own).between(low, high), F.size(F.array_intersect(own, _constant(words))))
        dice = 2.0 * shared / (F.size(own) + len(words))
        scored.append(F.when(dice >= percent / 100, F.struct((-dice).alias("d"), F.lit(name).alias("licence"))))
    return F.least(*scored)


def _units(text: Column) -> Column:
    lines, paragraphs = _lines(text), _paragraphs(text)
    several = F.transform(paragraphs, lambda p, i: F.struct(F.lit("paragraph").alias("unit"), i.alias("place"), p.alias("t")))
    return F.concat(
        F.transform(lines, lambda p, i: F.struct(F.lit("line").alias("unit"), i.alias("place"), p.alias("t"))),
        F.filter(several, lambda s: F.contains(s["t"], F.lit("\n"))),
        F.when(F.size(paragraphs) > 1, F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("place"), text.alias("t"))))
        .otherwise(F.filter(several, lambda s: F.lit(False))),
    )


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _paragraphs(text: Column) -> Column:
    return F.split(text, r"\n[\x20\x09-\x0D]*\n")


RUN = "struct<first: int, last: int, dice: double, licence: string>"


def _runs_of(pairs: Column, template: Column, percent: int) -> Column:
    """Runs in a list of bigrams that are like one template (licence, words, low, size, reach, lead), in order, none overlapping another."""
    want, reach, low, size = template["words"], template["reach"], template["low"], template["size"].cast("double")
    # (place, place of the same pair before, whether the template has it, whether it begins the template), in order of place.
    ordered = F.array_sort(F.transform(pairs, lambda w, i: F.struct(w.alias("w"), i.alias("p"))))

    def linked(at: Column) -> Column:
        def link(x: Column, i: Column) -> Column:
            back = F.get(at, i - 1)
            return F.struct(
                x["p"].alias("p"),
                F.when(back["w"] == x["w"], back["p"]).otherwise(-1).alias("before"),
                F.array_contains(want, x["w"]).alias("hit"),
                (x["w"] == template["lead"]).alias("lead"),
            )

        return F.array_sort(F.transform(at, link))

    def starts(q: Column, hits: Column) -> Column:
        def open_(x: Column, i: Column) -> Column:
            # Enough hits in reach. A run is as good or better with one more pair of the template on its left.
            enough = F.coalesce(F.get(hits, i + low - 1)["p"] < x["p"] + reach, F.lit(False))
            return enough & (x["lead"] | ~F.coalesce(F.get(q, x["p"] - 1)["hit"], F.lit(False)))

        return F.filter(hits, open_)

    def longest(q: Column, start: Column) -> Column:
        """The end with the greatest Dice coefficient, the first of several. Pairs that the run has already do not count again."""
        begin = F.struct(F.lit(0).alias("own"), F.lit(0).alias("shared"), F.lit(0.0).alias("dice"), start["p"].alias("last"))

        def step(acc: Column, x: Column) -> Column:
            new = x["before"] < start["p"]
            own = acc["own"] + F.when(new, 1).otherwise(0)
            shared = acc["shared"] + F.when(new & x["hit"], 1).otherwise(0)
            dice = 2.0 * shared / (own + size)
            better = dice > acc["dice"]
            return F.struct(
                own.alias("own"), shared.alias("shared"), F.when(better, dice).otherwise(acc["dice"]).alias("dice"),
                F.when(better, x["p"]).otherwise(acc["last"]).alias("last"),
            )

        return F.aggregate(
            F.slice(q, start["p"] + 1, reach), begin, step,
            lambda acc: F.struct(start["p"].alias("first"), (acc["last"] + 1).alias("last"), acc["dice"].alias("dice"), template["licence"].alias("licence")),
        )

    def apart(acc: Column, run: Column) -> Column:
        before = F.get(acc, F.size(acc) - 1)
        return (
            F.when(F.size(acc).eqNullSafe(0) | (run["first"] > before["last"]), F.concat(acc, F.array(run)))
            .when(run["dice"] > before["dice"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(run)))
            .otherwise(acc)
        )

    def all_of(q: Column) -> Column:
        ends = _let(F.filter(q, lambda x: x["hit"]), lambda hits: F.transform(starts(q, hits), lambda x: longest(q, x)))
        return F.aggregate(F.filter(ends, lambda r: r["dice"] >= percent / 100), F.array().cast(f"array<{RUN}>"), apart)

    return _let(_let(ordered, linked), all_of)


def _overlap(a: Column, b: Column) -> Column:
    return F.least(a["last"], b["last"]) - F.greatest(a["first"], b["first"]) + 1


def _stand(text: Column, runs: Column, sets: dict[str, list[str]], percent: int) -> Column:
    """The runs of a text that neither a unit nor a better run stands for."""

    def place(u: Column) -> Column:
        before = F.when(u["unit"] == "line", _lines(text)).when(u["unit"] == "paragraph", _paragraphs(text)).otherwise(F.array(F.lit("")))
        first = F.aggregate(F.slice(before, 1, u["place"]), F.lit(0), lambda n, t: n + F.size(_words(t)))
        return _let(_let(bigrams(u["t"]), lambda own: _best(own, sets, percent)), lambda best: _let(first, lambda n: F.struct(
            n.alias("first"), (n + F.size(_words(u["t"])) - 1).alias("last"), (-best["d"]).alias("dice"), best["licence"].alias("licence")
        )))

    def stays(r: Column, units: Column) -> Column:
        def beats(s: Column, sure: Column) -> Column:
            same = 2 * _overlap(r, s) > F.greatest(r["last"] - r["first"], s["last"] - s["first"]) + 1
            return same & ((s["dice"] > r["dice"]) | ((s["dice"] == r["dice"]) & sure))

        def holds(u: Column) -> Column:
            return (u["first"] <= r["first"]) & (u["last"] >= r["last"]) & (u["licence"] == r["licence"])

        return ~F.exists(units, lambda u: holds(u) | beats(u, F.lit(True))) & ~F.exists(runs, lambda s: beats(s, s["licence"] < r["licence"]))

    return _let(F.array_compact(F.transform(_units(text), place)), lambda units: F.filter(runs, lambda r: stays(r, units)))


def _inverted(sets: dict[str, list[str]], percent: int) -> list[str]:
    """Bigrams of which every unit or run that is like a template has at least one.

    It shares ``low`` bigrams of the template's ``size`` at least, so at least one of any ``size - low + 1`` of them: of the longest here.
    """
    out = set()
    for words in sets.values():
        low, _ = bounds(len(words), percent)
        out.update(sorted(words, key=lambda w: (-len(w), w))[: len(words) - low + 1])
    return sorted(out)


def _possible(documents: DataFrame, sets: dict[str, list[str]], percent: int) -> DataFrame:
    """The documents that hold any of the inverted list's bigrams, or the word of a template of one word."""
    listed = _inverted(sets, percent)
    held = documents.withColumn("words", _words(F.col("text"))).withColumn("pairs", _pairs(F.col("words")))
    tests = []
    for column, own in (("pairs", [w for w in listed if " " in w]), ("words", [w for w in listed if " " not in w])):
        if own:  # letters, digits and blanks only
            tests.append(f"exists({column}, x -> x IN ({', '.join(repr(w) for w in own)}))")
    return held.filter(" OR ".join(tests) or "false").select(*documents.columns)


def _runs(text: Column, sets: dict[str, list[str]], lengths: dict[str, int], leads: dict[str, str], percent: int) -> Column:
    """The runs of a text that no unit stands for, as array<RUN>; null for none."""
    least = min(bounds(len(s), percent)[0] for s in sets.values())
    short = sorted({w for s in sets.values() if len(s) <= SHORT for w in s})

    def likely(own: Column, common: Column) -> Column:
        out = []
        for name, words in sets.items():
            some = common if len(words) <= SHORT else own
            low = bounds(len(words), percent)[0]
            reach = max(bounds(lengths[name], percent)[1], lengths[name])
            template = F.struct(
                F.lit(name).alias("licence"), _constant(words).alias("words"), F.lit(low).alias("low"), F.lit(len(words)).alias("size"), F.lit(reach).alias("reach"),
                F.lit(leads[name]).alias("lead"),
            )
            out.append(F.when(F.size(some) >= low, F.when(F.size(F.array_intersect(some, _constant(words))) >= low, template)))
        return F.array_compact(F.array(*out))

    def of(pairs: Column) -> Column:
        distinct = F.when(F.size(pairs) >= least, F.array_distinct(pairs))
        templates = _let(distinct, lambda own: _let(F.array_intersect(own, _constant(short)) if short else F.slice(own, 1, 0), lambda common: likely(own, common)))
        return _let(templates, lambda ts: F.when(F.size(ts) > 0, F.flatten(F.transform(ts, lambda t: _runs_of(pairs, t, percent)))))

    return _let(_let(_let(_words(text), _pairs), of), lambda found: F.when(F.size(found) > 0, _stand(text, found, sets, percent)))


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, key: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """(key, unit, place, licence, dice) for each line, blank-line paragraph, whole text or run of words that is like a template.

    ``unit`` is ``line``, ``paragraph`` (of several lines) or ``text`` (of several paragraphs), ``place`` its number within the document
    from 0. The best template is named, of equally good ones the first by code point. Letters are lower-cased, words are runs of letters
    and digits. Null and empty texts have no units; repeated rows are found each; an empty table or no template gives an empty result.
    A unit of n words has at most n - 1 bigrams; units too short for every template are dropped by their number of words, and
    only templates whose size bounds admit a unit's number of bigrams are compared with it.

    A ``run`` is a row of consecutive words across lines and paragraphs, ``place`` the number of its first word. It starts with a bigram of
    the template that follows none of its bigrams or begins it, ends with one of them, and has at most as many bigrams, repeated ones counted, as the upper size bound of the template's own number.
    For each start the end with the greatest coefficient is taken, from left to right a run replaces the one before that it overlaps if
    it is better. Of runs of several templates that share more than half the words of the longer one the best stays. A run is left out
    where a unit found holds all of it and has the same licence, or shares more than half of the words and is as good. Templates of one word
    have no runs.
    """
    sets = {name: template_bigrams(t) for name, t in sorted(templates.items())}
    sets = {name: s for name, s in sets.items() if s}
    least = min((bounds(len(s), percent)[0] for s in sets.values()), default=1)
    documents = _possible(df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")), sets, percent)
    # A set of b bigrams takes more than b words, but for the single word.
    few = least + 1 if least > 1 else 1

    def found_as(u: Column) -> Column:
        best = _let(F.when(F.regexp_count(u["t"], F.lit(WORD)) >= few, bigrams(u["t"])), lambda own: _best(own, sets, percent))
        return _let(best, lambda b: F.struct(u["unit"].alias("unit"), u["place"].alias("place"), b["licence"].alias("licence"), (-b["d"]).alias("dice")))

    found = F.array_compact(F.transform(_units(F.col("text")), found_as))
    words = {name: re.findall(r"[^\W_]+", templates[name].lower()) for name in sets}
    lengths, leads = {name: len(w) - 1 for name, w in words.items()}, {name: " ".join(w[:2]) for name, w in words.items()}
    if several := {name: s for name, s in sets.items() if lengths[name]}:
        runs = F.coalesce(_runs(F.col("text"), several, lengths, leads, percent), F.array().cast(f"array<{RUN}>"))
        as_unit = lambda r: F.struct(F.lit("run").alias("unit"), r["first"].alias("place"), r["licence"].alias("licence"), r["dice"].alias("dice"))
        found = F.concat(found, F.transform(runs, as_unit))
    out = documents.select("key", F.explode(found).alias("u")).select("key", "u.*")
    return out.select(F.col("key").alias(key), "unit", F.col("place").cast("long").alias("place"), "licence", "dice")


def oracle(templates: dict[str, str] = TEMPLATES, percent: int = 80) -> str:
    """The lines, paragraphs and whole texts in DuckDB SQL, without pruning; it has no runs."""
    values = ", ".join(
        "('{}', [{}])".format(name.replace("'", "''"), ", ".join("'" + b.replace("'", "''") + "'" for b in template_bigrams(t)))
        for name, t in templates.items()
    )
    return f"""
WITH templates(licence, want) AS (VALUES {values}),
lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS l, regexp_split_to_array(text, '\\n[\\x20\\x09-\\x0D]*\\n') AS p, text
  FROM documents WHERE text IS NOT NULL
),
units AS (
  SELECT doc_id, 'line' AS unit, unnest(generate_series(0, len(l) - 1)) AS place, unnest(l) AS t FROM lines
  UNION ALL
  SELECT * FROM (
    SELECT doc_id, 'paragraph' AS unit, unnest(generate_series(0, len(p) - 1)) AS place, unnest(p) AS t FROM lines
  ) WHERE contains(t, chr(10))
  UNION ALL
  SELECT doc_id, 'text', 0, text FROM lines WHERE len(p) > 1
),
words AS (SELECT doc_id, unit, place, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM units),
sets AS (
  SELECT doc_id, unit, place, list_distinct(CASE WHEN len(w) > 1
    THEN list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS own
  FROM words WHERE len(w) > 0
),
scored AS (
  SELECT doc_id, unit, place, licence, 2.0::DOUBLE * len(list_intersect(own, want)) / (len(own) + len(want)) AS dice
  FROM sets, templates
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, unit, place ORDER BY dice DESC, licence) AS r FROM scored WHERE dice >= {percent / 100}
)
SELECT doc_id, unit, CAST(place AS BIGINT) AS place, licence, dice FROM ranked WHERE r = 1
"""
