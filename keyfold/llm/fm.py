"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A row's features are its distinct words hashed into ``2**word_bits`` buckets
(weighted by the logarithm of their counts and brought to length one), bins of
statistics of the text's structure, and bins of metadata columns. All pairs of
features interact through ``factors``-dimensional vectors; the sum over pairs
is half of (square of sum - sum of squares), so a row is scored in time linear
in its features. The model is fitted with AdaGrad on at most ``train_rows``
labelled rows, one for each identifier, whose features take ``train_bytes`` or
less (documented bounds, whatever the tables) and has a fixed size, so it is
broadcast. All rows are scored, by whole texts.

Defined cases: null texts count as empty; an empty text is scored by the bins
of its statistics; null metadata have a bin of their own; very long texts are
scored whole (only a text whose features are beyond a sixteenth of
``train_bytes`` is not learnt from); without labels, or with labels of one kind
only, the score is the smoothed share of label 1; repeated rows score alike; a
null identifier has no label and is scored; an empty table gives an empty
result; other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from keyfold.llm.features import bucket, collected, labelled, rows_of, word_hashes
from keyfold.llm.shared import crc_mod, table, whole_text
from keyfold.llm.words import slices

BINS = 16
STATS = 11


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray
    word_bits: int

    def score(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        z = np.full(n, self.bias)
        if len(row):
            at = np.flatnonzero(np.diff(row, prepend=-1))
            x = value[:, None]
            vx = self.vectors[feature] * x
            total = np.add.reduceat(vx, at, axis=0)
            z[row[at]] += np.add.reduceat(self.weights[feature] * value, at) + 0.5 * (total**2 - np.add.reduceat(vx**2, at, axis=0)).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _log_bin(x: np.ndarray) -> np.ndarray:
    return np.clip(np.log2(1 + np.maximum(x, 0)), 0, BINS - 1).astype(np.int64)


def _share_bin(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    share = part / np.maximum(whole, 1)
    return np.where(whole > 0, 1 + np.clip(np.sqrt(share) * (BINS - 2), 0, BINS - 2).astype(np.int64), 0)


def features(text: pa.Array, metadata: list[pa.Array], word_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and value of each feature of a batch, by row."""
    n = len(text)
    hashes, starts = word_hashes(text)
    row = rows_of(starts)
    cells, counts = np.unique((row << word_bits) | bucket(hashes, 1, word_bits), return_counts=True)
    word_row, word = cells >> word_bits, cells & ((1 << word_bits) - 1)
    weight = np.log1p(counts)
    norm = np.sqrt(np.bincount(word_row, weight**2, minlength=n))
    weight = weight / np.maximum(norm[word_row], 1e-9)

    raw = text.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + n + 1]
    sizes = np.diff(offsets)
    full = np.flatnonzero(sizes)
    kinds = np.zeros((6, n))
    if len(full):
        data = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        at = (offsets - offsets[0])[full]
        masks = (
            (data >= 65) & (data <= 90),
            (data >= 48) & (data <= 57),
            ((data > 32) & (data < 48)) | ((data > 57) & (data < 65)) | ((data > 90) & (data < 97)) | ((data > 122) & (data < 127)),
            (data <= 32),
            data == 10,
            data >= 128,
        )
        for k, mask in enumerate(masks):
            kinds[k, full] = np.add.reduceat(mask, at, dtype=np.int64)
    words = np.diff(starts)
    distinct = np.bincount(word_row, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, word_row, counts)
    again = np.zeros(n)
    if len(hashes) > 1:
        again = np.bincount(row[1:], (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1]), minlength=n)
    letters = np.maximum(sizes - kinds[3], 0)
    bins = [
        _log_bin(sizes),
        _log_bin(words),
        np.minimum(BINS - 1, (letters / np.maximum(words, 1)).astype(np.int64)),
        _share_bin(kinds[0], letters),
        _share_bin(kinds[1], letters),
        _share_bin(kinds[2], letters),
        _share_bin(kinds[3], sizes),
        _share_bin(kinds[4], sizes),
        _share_bin(distinct, words),
        _share_bin(most, words),
        _share_bin(again, words),
    ]
    for m in metadata:
        values = m.cast(pa.float64()).to_numpy(zero_copy_only=False)
        bins.append(np.where(np.isnan(values), 0, 1 + np.minimum(BINS - 2, _log_bin(np.nan_to_num(values)))))
    base = 1 << word_bits
    rows = np.concatenate([word_row, *[np.arange(n)] * len(bins)])
    feature = np.concatenate([word, *[base + k * BINS + b for k, b in enumerate(bins)]])
    value = np.concatenate([weight, np.full(n * len(bins), 0.5)])
    order = np.argsort(rows, kind="stable")
    return rows[order], feature[order], value[order]


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], word_bits: int, metadata: int, factors: int = 8, epochs: int = 8, steps: int = 800, rate: float = 0.08, seed: int = 7) -> Model:
    """AdaGrad on the logistic loss over mini-batches of 128 rows; at least ``epochs`` rounds and ``steps`` batches."""
    size = (1 << word_bits) + (STATS + metadata) * BINS
    rng = np.random.default_rng(seed)
    y = np.array([r[2] for r in rows], dtype=np.float64)
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    model = Model(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.05, (size, factors)), word_bits)
    if not 0 < y.sum() < len(y):
        model.vectors[:] = 0
        return model
    gw, gv, gb = np.full(size, 1e-2), np.full((size, factors), 1e-2), 1e-2
    for _ in range(max(epochs, -(-steps * 128 // len(rows)))):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 128):
            part = [rows[i] for i in order[k : k + 128]]
            lengths = np.array([len(r[0]) for r in part])
            f, x = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part]).astype(np.float64)
            at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            v = model.vectors[f]
            vx = v * x[:, None]
            total = np.add.reduceat(vx, at, axis=0)
            z = model.bias + np.add.reduceat(model.weights[f] * x, at) + 0.5 * (total**2 - np.add.reduceat(vx**2, at, axis=0)).sum(axis=1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[order[k : k + 128]]) / len(part)
            e = np.repeat(error, lengths)
            slope = (e * x)[:, None] * (np.repeat(total, lengths, axis=0) - vx)
            seen, own = np.unique(f, return_inverse=True)
            dw = np.bincount(own, e * x, len(seen)) + 1e-6 * model.weights[seen]
            dv = np.stack([np.bincount(own, slope[:, j], len(seen)) for j in range(factors)], axis=1) + 1e-6 * model.vectors[seen]
            gw[seen] += dw**2
            gv[seen] += dv**2
            gb += error.sum() ** 2
            model.weights[seen] -= rate * dw / np.sqrt(gw[seen])
            model.vectors[seen] -= rate * dv / np.sqrt(gv[seen])
            model.bias -= rate * error.sum() / np.sqrt(gb)
    return model


def train(docs: DataFrame, labels: DataFrame, learn, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = (), train_rows: int = 12_000, train_bytes: int = 48 << 20, word_bits: int = 15) -> Model:
    names = [f"_m{i}" for i in range(len(metadata))]
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text"), *[F.col(c).cast("double").alias(m) for c, m in zip(metadata, names)])
    known = labelled(rows, labels.withColumnRenamed(id_col, "_id"), label, learn, train_rows).select("label", "_h", "_text", *names)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, 3 << 20):
            r, f, x = features(b.column(2), b.columns[3:], word_bits)
            ends = np.searchsorted(r, np.arange(len(b) + 1))
            cut = [(f[i:j].astype("<i4").tobytes(), x[i:j].astype("<f4").tobytes()) for i, j in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([c[0] for c in cut], pa.binary()), pa.array([c[1] for c in cut], pa.binary())], names=["label", "_h", "f", "x"])

    got = collected(known.mapInArrow(cells, "label int, _h long, f binary, x binary"), F.octet_length("f") * 2, train_bytes)
    rows = [(np.frombuffer(f, "<i4"), np.frombuffer(x, "<f4"), y) for f, x, y in zip(*(got.column(c).to_pylist() for c in ("f", "x", "label")))]
    return fit(rows, word_bits, len(metadata))


def score(docs: DataFrame, model: Model, text_col: str = "text", metadata: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """``docs`` with a score between 0 and 1; all other columns stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in docs.columns if c != name]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in slices(batches, 1, 2 << 20):
            r, f, x = features(b.column(1), b.columns[2:], m.word_bits)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.score(r, f, x, len(b)))], names=["doc", "score"])

    # the row as one column: its names cannot meet those used here
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("doc"), whole_text(text_col).alias("text"), *[F.col(c).cast("double").alias(f"m{i}") for i, c in enumerate(metadata)])
    out = rows.mapInArrow(scored, StructType([rows.schema["doc"], StructField("score", DoubleType())]))
    return out.select("doc.*", F.col("score").alias(name))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return train(docs, table(spark, sf_dir, "labels"), crc_mod("_id", 3) != 1, metadata=("n_chars",))


def op1_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_model(spark, docs, sf_dir)
    out = score(docs.select("doc_id", "text", "n_chars"), model, metadata=("n_chars",))
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
