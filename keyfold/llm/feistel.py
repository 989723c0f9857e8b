"""Sharding by a Feistel permutation over global row numbers.

Rows are numbered 0..n-1 in the order of their identifiers, a keyed Feistel
network with cycle walking permutes those numbers, and the permuted number p
goes to shard p mod s, slot p div s. Shard sizes differ by at most one row,
slots are gapless, and both directions can be computed without any table:
:func:`place` gives the shard and slot of a row number, :func:`row_at` the row
number that sits at a shard and slot.

Defined cases: a null text has no bytes (size is the overhead alone) and the
CRC of an empty text; rows with equal identifiers are told apart by checksum
and size, and rows equal in all of these are interchangeable; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm.shared import numbered, table, whole_text

ROUNDS = 6
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)  # fixed values: the splitmix64 finaliser


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = x + np.uint64(key)
        z = (z ^ (z >> np.uint64(30))) * M1
        z = (z ^ (z >> np.uint64(27))) * M2
        return z ^ (z >> np.uint64(31))


def _keys(seed: int) -> list[int]:
    step = 0x9E3779B97F4A7C15  # fixed value: 2**64 divided by the golden ratio
    return [(seed * 0xD1342543DE82EF95 + (r + 1) * step) % 2**64 for r in range(ROUNDS)]


def _half_bits(n: int) -> int:
    return max(1, (max(n - 1, 1).bit_length() + 1) // 2)


def _network(x: np.ndarray, half: int, keys: list[int], back: bool) -> np.ndarray:
    mask = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ (_mix(left, key) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key) & mask)
    return (left << np.uint64(half)) | right


def permute(rows: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (or its inverse); numbers that leave the range walk on until they return."""
    half, keys = _half_bits(n), _keys(seed)
    out = _network(np.asarray(rows, dtype=np.uint64), half, keys, back)
    while (outside := out >= np.uint64(n)).any():
        out[outside] = _network(out[outside], half, keys, back)
    return out.astype(np.int64)


def place(rows: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    p = permute(rows, n, seed)
    return p % shards, p // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int) -> np.ndarray:
    return permute(np.asarray(slot, dtype=np.int64) * shards + np.asarray(shard, dtype=np.int64), n, seed, back=True)


def shard(docs: DataFrame, shards: int = 40, seed: int = 20_240_101, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """id, size, text_crc32, row_no, shard, slot for every row of ``docs``."""
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col), (F.octet_length(text).cast("long") + overhead).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = numbered(rows, [F.asc_nulls_first(id_col), "text_crc32", "size"])
    n = rows.count()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, t = place(b.column("row_no").to_numpy(), n, shards, seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s.astype(np.int32)), pa.array(t)], names=[*b.schema.names, "shard", "slot"])

    kind = dict(rows.dtypes)[id_col]
    return rows.select(id_col, "size", "text_crc32", "row_no").mapInArrow(placed, f"`{id_col}` {kind}, size long, text_crc32 long, row_no long, shard int, slot long")


def op8_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
