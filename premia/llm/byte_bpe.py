"""Byte-level BPE with the tiktoken library: texts to token ids and ids back to bytes.

Rows are independent, so nothing is shuffled. A null text encodes as the empty text; null ids decode to empty bytes. All
other columns pass through, whatever they are called, as long as they are not the output column's name. Texts may be of any
length: long ones are split at borders of white space, and long runs of white space, for which the library's matcher would
need a stack of their length, are encoded as the one match that they are. Patterns must treat white space as
`\\s+(?!\\S)|\\s+` does, and match at most one white-space character before another.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from premia.llm.common import slices

#: Longer texts are split before the library sees them, so that one call's memory stays bounded.
LONG = 1 << 16
#: Characters of `\\s` in the library's matcher (fixed values).
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space after another character: a match of the pattern always begins at it, and no match before it looks past it.
_SAFE = re.compile(f"(?<=[^{_WHITE}])[{_WHITE}]")
#: Runs that the matcher does not see. All of a run, but for its last character where another one follows, is one match.
_RUN = re.compile(f"[{_WHITE}]{{4096,}}")


@lru_cache(maxsize=4)
def encoder(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def cut(text: str, limit: int = LONG) -> Iterator[str]:
    """Parts of about `limit` characters that encode to the whole text's ids one after another."""
    at = 0
    while len(text) - at > limit:
        found = _SAFE.search(text, at + limit - 1)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode_one(own: tiktoken.Encoding, text: str) -> list[np.ndarray]:
    """Ids of a whole text, in parts."""
    out, at = [], 0
    for run in _RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        out += [own.encode_to_numpy(x, disallowed_special=()) for x in cut(text[at : run.start()])]
        out.append(np.array(own._core_bpe.encode_single_piece(text[run.start() : end].encode()), np.uint32))
        at = end
    out += [own.encode_to_numpy(x, disallowed_special=()) for x in cut(text[at:])]
    return out


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with the token ids of each whole text in place of the text. No special tokens are read or added."""
    rest = [f for f in docs.schema.fields if f.name not in (text, ids)]
    schema = T.StructType([*rest, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        own = encoder(rank_file, pattern)
        for batch in batches:
            for part in slices(batch, text):
                found = [encode_one(own, t) for t in part.column(text).fill_null("").to_pylist()]
                sizes = np.array([sum(map(len, x)) for x in found], np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.concatenate([y for x in found for y in x]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), column.cast(arrow.field(ids).type)], schema=arrow)

    return docs.select(*[f"`{f.name}`" for f in rest], f"`{text}`").mapInArrow(run, schema)


def decode(encoded: DataFrame, rank_file: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`encoded` with the bytes its ids stand for."""
    rest = [f for f in encoded.schema.fields if f.name != out]
    schema = T.StructType([*rest, T.StructField(out, T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        own = encoder(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [b"" if x is None else own.decode_bytes(x) for x in part.column(ids).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in rest), pa.array(found, pa.binary())], schema=arrow)

    return encoded.select(*[f"`{f.name}`" for f in rest]).mapInArrow(run, schema)
