"""Hashed features of whole texts, a batch at a time, and bounded samples of labelled rows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyfold.llm.shared import dropped, saved

EDGE = b".,;:!?\"'()[]{}*&%$#-_/\\<>|~`^=+@"
A1, A2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)  # fixed values: odd multipliers


def word_hashes(text: pa.Array, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """A 32-bit hash of each lower-cased word without punctuation at its ends (0 where nothing is left), and where each row's words start.

    For each of ``stems``, the hashes of the words' first so many letters follow.
    """
    text = text.cast(pa.large_string()).take(pa.array(np.arange(len(text))))  # a sliced array would be split as if it were whole
    parts = pc.ascii_split_whitespace(pc.ascii_lower(text))
    starts = parts.offsets.to_numpy().astype(np.int64)
    words = parts.flatten().dictionary_encode()
    at = words.indices.to_numpy() if len(words) else np.zeros(0, dtype=np.int64)
    names = [w.strip(EDGE) for w in words.dictionary.cast(pa.large_binary()).to_pylist()]
    hashed = lambda parts: np.fromiter(map(zlib.crc32, parts), dtype=np.uint64, count=len(names))[at]
    out = [hashed(names), starts - starts[0]]
    if stems:
        letters = [w.decode("utf-8", "replace") for w in names]
        out += [hashed([w[:k].encode() for w in letters]) for k in stems]
    return tuple(out)


def rows_of(starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts) - 1), np.diff(starts))


def bucket(h: np.ndarray, salt: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (h + np.uint64(salt)) * A1
        z = (z ^ (z >> np.uint64(29))) * A2
    return (z >> np.uint64(64 - bits)).astype(np.int64)


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int) -> DataFrame:
    """Rows of ``docs`` (with ``_id``) and their labels (0 or 1), for which ``learn`` holds: at most ``most`` rows, one for each identifier.

    Identifiers are sampled by a hash before the join, so that the side that is
    broadcast is bounded; of rows that share an identifier the one with the
    lowest hash stays, by an aggregation that begins where the rows are. The
    same rows are chosen however the tables are split.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col("_id").isNotNull() & learn).groupBy("_id").agg(F.max(label).cast("int").alias("label"))
    known = saved(known.withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(most), "labels")  # two numbers and a label each
    rows = docs.join(F.broadcast(known.select(F.col("_id").alias("_known"), "label", "_h")), F.col("_id") == F.col("_known")).drop("_known")
    others = [c for c in rows.columns if c not in ("_id", "_h")]
    return rows.groupBy("_id", "_h").agg(F.min_by(F.struct(*others), F.xxhash64(*docs.columns)).alias("x")).select("x.*", "_h")


def collected(rows: DataFrame, size: Column, most_bytes: int) -> pa.Table:
    """Rows of a bounded sample in the order of ``_h``, as long as their ``size`` adds up to ``most_bytes`` or less; none above a sixteenth of that.

    The sizes alone are looked at first.
    """
    rows = saved(rows.withColumn("_size", size.cast("long")).filter(F.col("_size") <= most_bytes // 16), "sample")
    sizes = rows.select("_h", "_size").toArrow().sort_by("_h")
    fit = int((np.cumsum(sizes.column("_size").to_numpy()) <= most_bytes).sum()) if len(sizes) else 0
    top = sizes.column("_h")[fit - 1].as_py() if fit else -(1 << 63)
    got = rows.filter(F.col("_h") <= top).drop("_size").toArrow().sort_by("_h")
    dropped(rows)
    return got[:fit]
