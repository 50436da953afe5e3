"""Removal of repeated runs of lines, natively: naming by prefix doubling over the line-ID sequences of all documents.

The suffixes of all documents' line sequences are grouped by their first 1, 2, 4, ... lines, as a suffix array's doubling
does; a class is named by its earliest suffix, and suffixes alone in their class leave at once, so that each round works
on what still repeats. Depth `least` is reached by joining two overlapping classes. The intervals of suffixes with a common
prefix of `least` lines or more are then the classes at that depth; the union of their lines is the union of all maximal
repeated runs, and every suffix but the earliest of its class is a later copy, whose lines go.
A single line is a run as well where `alone` says so: when it has that many words, or LETTERS characters (scripts
without spaces, URLs), wherever it stands; or when it is the only line of its document and that of an earlier one too.

Defined results: lines are split at line feeds; blank lines are never part of a run and stay. A null text stays null. Rows
without a key lose nothing and cause nothing. "Earlier" is a smaller key, then an earlier line. Rows that repeat a key are
one document read twice. A document may lose all of its lines; its row stays, with an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from premia.llm.common import written

#: Lines of the shortest run that counts.
LEAST = 2
#: Words, or characters, that make a single line a run.
ALONE, LETTERS = 20, 200
_DOC, _AT = "_doc", "_at"


def _class(rows: DataFrame, *names: str) -> DataFrame:
    """Rows whose `names` occur again, with the first row (doc, at) of their class."""
    first = rows.groupBy(*names).agg(F.min(F.struct(_DOC, _AT)).alias("first"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first.select(*names, "first"), list(names)).select(_DOC, _AT, "first")


def _double(named: DataFrame, step: int) -> DataFrame:
    """Classes of two named prefixes, the second `step` lines on."""
    ahead = named.select(_DOC, (F.col(_AT) - step).alias(_AT), F.col("first").alias("second"))
    pairs = named.join(ahead, [_DOC, _AT])
    flat = pairs.select(_DOC, _AT, F.col("first")[_DOC].alias("a"), F.col("first")[_AT].alias("b"), F.col("second")[_DOC].alias("c"), F.col("second")[_AT].alias("d"))
    return written(_class(flat, "a", "b", "c", "d"))


def _split(text: str) -> Column:
    return F.split(F.col(text), "\n", -1)


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, alone: int | None = None) -> DataFrame:
    """(_doc, line): indexes of the lines of each document that a later copy of a run covers."""
    own = docs.select(F.col(key).alias(_DOC), _split(text).alias("lines")).where(f"{_DOC} IS NOT NULL AND lines IS NOT NULL")

    def long(x: Column) -> Column:
        if alone is None:
            return F.lit(False)
        # so many words have as many separators less one
        enough = F.when(F.length(x) >= 2 * alone - 1, F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")) >= alone)
        return (F.length(x) >= LETTERS) | F.coalesce(enough, F.lit(False))

    # a line's id: two hashes, 128 bits together; blank lines have none
    ids = F.filter(
        F.transform("lines", lambda x, i: F.when(F.trim(x) != "", F.struct(i.cast("int").alias("line"), F.xxhash64(x).alias("h"), F.xxhash64(F.lit(7), x).alias("g"), long(x).alias("long")))),
        lambda x: x.isNotNull(),
    )
    rows = own.select(_DOC, ids.alias("ids")).select(_DOC, (F.size("ids") == 1).alias("only"), F.posexplode("ids").alias(_AT, "x"))
    rows = rows.select(_DOC, _AT, "x.line", "x.h", "x.g", "x.long", "only").distinct()
    place = F.struct(_DOC, _AT)
    first = rows.groupBy("h", "g").agg(F.min(place).alias("first"), F.min(F.when(F.col("only"), place)).alias("whole"), F.count("*").alias("n")).where("n > 1")
    lines = written(rows.join(first.select("h", "g", "first", "whole"), ["h", "g"]).select(_DOC, _AT, "line", "first", "whole", "long", "only"))
    named, depth = lines.select(_DOC, _AT, "first"), 1
    while depth < least:
        step = min(depth, least - depth)
        named, depth = _double(named, step), depth + step

    def after(name: str) -> Column:
        return (F.col(_DOC) != F.col(name)[_DOC]) | (F.col(_AT) != F.col(name)[_AT])

    covered = named.where(after("first")).select(_DOC, F.explode(F.sequence(F.col(_AT), F.col(_AT) + least - 1)).alias(_AT))
    if alone is not None:
        covered = covered.unionByName(lines.where((F.col("long") & after("first")) | (F.col("only") & after("whole"))).select(_DOC, _AT))
    return lines.select(_DOC, _AT, "line").join(covered.distinct(), [_DOC, _AT], "left_semi").select(_DOC, "line")


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, alone: int | None = None) -> DataFrame:
    """`docs` with n_lines, removed (indexes of the lines that go) and kept (the text without them)."""
    gone = repeated_lines(docs, key, text, least, alone).groupBy(_DOC).agg(F.sort_array(F.collect_set("line")).alias("removed"))
    rest = [c for c in docs.columns if c not in ("n_lines", "removed", "kept")]
    whole = docs.select(*[F.col(f"`{c}`") for c in rest]).join(gone, F.col(f"`{key}`") == F.col(_DOC), "left").drop(_DOC)
    lines, removed = _split(text), F.col("removed")
    # between one removed line and the next
    between = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size(removed)),
            lambda j: F.slice(lines, F.when(j == 0, 1).otherwise(F.get(removed, j - 1) + 2), F.when(j == F.size(removed), F.size(lines)).otherwise(F.get(removed, j)) - F.when(j == 0, 0).otherwise(F.get(removed, j - 1) + 1)),
        )
    )
    return whole.select(
        *[F.col(f"`{c}`") for c in rest],
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(removed, F.array().cast("array<int>")).alias("removed"),
        F.when(removed.isNull(), F.col(text)).otherwise(F.array_join(between, "\n")).alias("kept"),
    )
