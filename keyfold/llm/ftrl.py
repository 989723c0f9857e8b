"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, their stems (the first four and five letters),
stems that come twice, three or five times, word pairs and pairs with one word
between them, hashed into ``2**bits`` buckets. FTRL-proximal keeps a learning rate for
each coordinate and its L1 term leaves most weights at exactly zero, so that
the model is a short list of buckets and weights, which is broadcast. It is
fitted on at most ``train_rows`` labelled rows, one for each identifier, whose
features take ``train_bytes`` or less: documented bounds, whatever the tables.
All rows are scored, by whole texts.

Defined cases: null texts count as empty; an empty text scores by the bias
alone; very long texts are scored whole (only a text whose features are beyond
a sixteenth of ``train_bytes`` is not learnt from); without labels, or with
labels of one kind only, the score is the smoothed share of label 1; repeated
rows score alike; a null identifier has no label and is scored; an empty table
gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm.features import A2, bucket, collected, labelled, rows_of, word_hashes
from keyfold.llm.shared import crc_mod, table, whole_text
from keyfold.llm.words import slices


STEMS = (4, 5)
AGAIN = (2, 3, 5)


@dataclass
class Model:
    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    bits: int

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.bits)
        w[self.buckets] = self.weights
        return w


def grams(text: pa.Array, bits: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of the distinct features of a batch (of those whose bucket is ``wanted``)."""
    hashes, starts, *stems = word_hashes(text, STEMS)
    row = rows_of(starts)
    found = []
    for salt, (words, gap) in enumerate([(hashes, 0), (hashes, 1), (hashes, 2), *[(s, 0) for s in stems]], 1):
        if len(words) <= gap:
            continue
        with np.errstate(over="ignore"):
            h = words[:-gap] * A2 + words[gap:] if gap else words
        b, r = bucket(h, salt, bits), row[: len(h)]
        ok = row[gap:] == r if gap else np.ones(len(h), dtype=bool)
        if wanted is not None:
            ok &= wanted[b]
        found.append((r[ok] << bits) | b[ok])
    if len(hashes):
        # stems that come back: words of one root more often than by chance
        cells, times = np.unique((row << bits) | bucket(stems[0], 9, bits), return_counts=True)
        for k in AGAIN:
            r, h = cells[times >= k] >> bits, (cells[times >= k] & ((1 << bits) - 1)).astype(np.uint64)
            b = bucket(h, 9 + k, bits)
            ok = np.ones(len(b), dtype=bool) if wanted is None else wanted[b]
            found.append((r[ok] << bits) | b[ok])
    cells = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    return cells >> bits, cells & ((1 << bits) - 1)


def fit(rows: list[tuple[np.ndarray, int]], bits: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 6.0, l2: float = 0.1, epochs: int = 6, least_rows: int = 3, seed: int = 11) -> Model:
    """One row at a time, over features that at least ``least_rows`` different rows have; L1 leaves the bias alone."""
    rows = list({(xxhash.xxh3_128_digest(f), label): (f, label) for f, label in rows}.values())
    seen = np.zeros(1 << bits, dtype=np.int32)
    for f, _ in rows:
        seen[f] += 1
    seen = seen >= least_rows
    rows = [(f[seen[f]], label) for f, label in rows]
    y = np.array([r[1] for r in rows], dtype=np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    start = float(np.log(share / (1 - share)))
    if not 0 < y.sum() < len(y):
        return Model(start, np.zeros(0, dtype=np.int64), np.zeros(0), bits)
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    bias = start
    rng = np.random.default_rng(seed)

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            f = rows[k][0]
            w = weights(f)
            g = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -30, 30))) - y[k]
            s = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / alpha
            z[f] += g - s * w
            n[f] += g * g
            sb = (np.sqrt(nb + g * g) - np.sqrt(nb)) / alpha
            zb += g - sb * (bias - start)
            nb += g * g
            bias = start - zb / ((beta + np.sqrt(nb)) / alpha)
    kept = np.flatnonzero(np.abs(z) > l1)
    return Model(bias, kept, weights(kept), bits)


def train(docs: DataFrame, labels: DataFrame, learn, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", train_rows: int = 10_000, train_bytes: int = 48 << 20, bits: int = 20) -> Model:
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"))
    known = labelled(rows, labels.withColumnRenamed(id_col, "_id"), label, learn, train_rows).select("label", "_text", "_h")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 3 << 20):
            r, f = grams(b.column(1), bits)
            ends = np.searchsorted(r, np.arange(len(b) + 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[i:j].astype("<i4").tobytes() for i, j in zip(ends[:-1], ends[1:])], pa.binary()), b.column(2)], names=["label", "f", "_h"])

    got = collected(known.mapInArrow(cells, "label int, f binary, _h long"), F.octet_length("f"), train_bytes)
    return fit([(np.frombuffer(f, "<i4"), y) for f, y in zip(got.column("f").to_pylist(), got.column("label").to_pylist())], bits)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        w = m.dense()
        wanted = w != 0
        for b in slices(batches, 1, 2 << 20):
            r, f = grams(b.column(1), m.bits, wanted)
            z = m.bias + np.bincount(r, w[f], minlength=len(b))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(scored, f"id {dict(rows.dtypes)['id']}, score double").withColumnRenamed("id", id_col)


def op3_ftrl_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), crc_mod("_id", 4) != 2)
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
