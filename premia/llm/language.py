"""Language identification by rank-order profiles of character n-grams.

A language's profile is its most frequent 1- to 3-grams of letters, in order, over all of its training texts; word ends
count as a blank. A document's own most frequent n-grams are compared with each profile by how far each is out of place;
an n-gram the profile lacks counts as far as can be. Letters are lower-cased. N-grams of one batch of documents are
counted by sorting one array of numbers, and a profile is a table of ranks, so no Python runs per character.

Defined results: a null text, or one without a letter, is `und` with score 0. Without a training text every document is
`und`. Ties of counts go to the smaller n-gram code, ties of distance to the language first in order of name. Repeated
rows are scored, and counted in training, each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from premia.llm.common import flat, rows_of, slices

#: N-grams of a profile, and of a document.
PROFILE = 400
#: Codes of n-grams: 63 bits hold three letters of 21 bits, which are code points.
_BITS = 21
_POINTS = 0x110000
_WORK_BYTES = 1 << 20


def _folding() -> np.ndarray:
    """For each code point: a letter's lower-case form (0: not a letter; 1 is kept for the blank)."""
    code = np.zeros(_POINTS, np.int32)
    for x in range(_POINTS):
        c = chr(x)
        if c.isalpha():
            code[x] = ord(c.lower()[0])
    return code


_FOLD: list[np.ndarray] = []


def letters(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all rows' characters, a blank (1) for each run of others and at row ends; each code's row."""
    if not _FOLD:
        _FOLD.append(_folding())
    data, bounds = flat(text)
    lead = (data & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    if len(at):
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    else:
        points = np.zeros(0, np.uint32)
    code = _FOLD[0][points]
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(np.searchsorted(at, bounds)))
    # one blank before each row, and one for each run of other characters
    n = len(bounds) - 1
    first = np.searchsorted(row, np.arange(n))
    code = np.insert(code, first, 0)
    row = np.insert(row, first, np.arange(n))
    other = code == 0
    again = other.copy()
    again[1:] &= other[:-1] & (row[1:] == row[:-1])
    again[:1] = False
    keep = ~again
    return np.where(other, 1, code)[keep], row[keep]


def grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, n-gram code, count) of each distinct n-gram of each row, in order of row and code."""
    code, row = letters(text)
    # these texts' letters by number, in order, so that a row and three letters mostly fit one key
    there = np.zeros(_POINTS, bool)
    there[code] = True
    there[:2] = True
    alphabet = np.flatnonzero(there)
    number = np.zeros(_POINTS, np.int32)
    number[alphabet] = np.arange(len(alphabet))
    code = number[code]
    bits = int(len(alphabet) - 1).bit_length()
    rows, values = [row[code != 1]], [code[code != 1].astype(np.int64)]
    for size in (2, 3):
        n = len(code) - size + 1
        if n <= 0:
            continue
        value = code[:n].astype(np.int64)
        same = row[:n] == row[size - 1 :]
        for k in range(1, size):
            value = (value << bits) | code[k : n + k]
        if size == 3:
            same &= code[1 : n + 1] != 1
        same &= value != (1 << bits) + 1
        rows.append(row[:n][same])
        values.append(value[same])
    row, value = np.concatenate(rows).astype(np.int64), np.concatenate(values)
    if len(row) and 3 * bits + int(row.max()).bit_length() <= 63:
        keys = np.sort((row << (3 * bits)) | value)
        row, value = keys >> (3 * bits), keys & ((1 << (3 * bits)) - 1)
    else:
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    row, value, n = row[at], value[at], np.diff(np.append(at, len(row)))
    whole = np.zeros(len(value), np.int64)
    for k in (2, 1, 0):
        whole = (whole << _BITS) | alphabet[(value >> (k * bits)) & ((1 << bits) - 1)]
    return row, whole, n


@dataclass(frozen=True)
class Profiles:
    names: tuple[str, ...]
    codes: np.ndarray  #: (languages, PROFILE) n-gram codes in order, -1 where there are fewer

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """All codes that any profile holds, sorted; their rank in each language, PROFILE where it lacks them."""
        known = np.unique(self.codes[self.codes >= 0])
        rank = np.full((len(self.names), len(known) + 1), PROFILE, np.int32)
        for k, codes in enumerate(self.codes):
            own = codes[codes >= 0]
            rank[k, np.searchsorted(known, own)] = np.arange(len(own))
        return known, rank


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of all languages in `docs`; rows without a text or a language take no part.

    Counts are summed per slice of texts and language, then by Spark; PROFILE codes per language reach the driver.
    """
    schema = pa.schema([("lang", pa.string()), ("code", pa.int64()), ("n", pa.int64())])

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text", _WORK_BYTES):
                row, code, n = grams(part.column("text"))
                lang = part.column("lang").dictionary_encode()
                which = lang.indices.to_numpy(zero_copy_only=False)[row].astype(np.int64)
                order = np.lexsort((code, which))
                which, code, n = which[order], code[order], n[order]
                new = np.ones(len(code), bool)
                new[1:] = (which[1:] != which[:-1]) | (code[1:] != code[:-1])
                at = np.flatnonzero(new)
                if len(at):
                    yield rows_of(schema, lang=lang.dictionary.take(pa.array(which[at])), code=code[at], n=np.add.reduceat(n, at))

    learnt = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = learnt.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE).collect()
    names = tuple(sorted({r.lang for r in best}))
    codes = np.full((len(names), PROFILE), -1, np.int64)
    for r in best:
        codes[names.index(r.lang), r["rank"] - 1] = r.code
    return Profiles(names, codes)


def predict(docs: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score): score is how much nearer the best profile is than the farthest possible, 0 to 1."""
    known, rank = profiles.ranks() if profiles.names else (np.zeros(0, np.int64), np.zeros((0, 1), np.int32))
    names = np.array([*profiles.names, "und"], dtype=object)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", _WORK_BYTES):
                n = part.num_rows
                best, score = np.full(n, len(names) - 1), np.zeros(n)
                row, code, count = grams(part.column("text"))
                if len(row) and len(names) > 1:
                    # each row's most frequent n-grams, in order
                    order = np.lexsort((code, -count, row))
                    row, code = row[order], code[order]
                    first = np.searchsorted(row, np.arange(n))
                    place = np.arange(len(row)) - first[row]
                    top = place < PROFILE
                    row, code, place = row[top], code[top], place[top]
                    at = np.searchsorted(known, code)
                    at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != code)] = len(known)
                    size = np.bincount(row, minlength=n)
                    away = np.empty((len(names) - 1, n))
                    for k in range(len(names) - 1):
                        r = rank[k, at]
                        away[k] = np.bincount(row, weights=np.where(r == PROFILE, PROFILE, np.abs(r - place)), minlength=n)
                    has = size > 0
                    best = np.where(has, away.argmin(axis=0), len(names) - 1)
                    score = np.where(has, 1 - away.min(axis=0) / np.maximum(1, size * PROFILE), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1))], names=["key", "lang_pred", "score"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


