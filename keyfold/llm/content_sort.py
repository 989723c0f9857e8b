"""Exact deduplication by sorting on content.

Sampled splitters deal the rows out by the first characters of the normalised
text (its digest and the identifier break ties, so that not even one text that
makes up a third of the corpus falls to one task). Each task sorts its range by
the whole normalised bytes with Spark's external sort, which puts equal texts
side by side, and one pass compares neighbours in full. A text may go on in the
next range only if it begins or ends its own, by the order of the splitters;
those two of each task, and texts that come so often that the pass hands them on
in pieces of ``PIECE`` rows, are told apart by a summary each (text, first
identifier, rows), and summaries of equal texts are joined. No task holds more
of a text's rows than a piece, nor more than one copy of their text.

Defined cases: a null text counts as empty; empty texts are equal to each
other; very long texts are compared whole; of equal texts one row stays, the one
with the largest (or smallest) identifier, and among rows with the same
identifier any one; a null identifier is chosen only if the group has no other;
an empty table gives an empty result. Columns other than those named are
ignored, whatever their names; a carried one that has the name of a result
column comes as ``carried_<name>``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm.shared import saved, shuffle_partitions, table

PIECE, PIECE_BYTES = 1 << 16, 32 << 20
BROADCAST_ROWS = 1_000_000  # of five small columns
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def _runs(small: list[str], names: list[str], chars: int, body: bool, heads_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Turn rows in the order of their text into rows with their run's number and size, and the summaries of some runs."""

    def run_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, run = TaskContext.get().partitionId(), 0
        waiting: list[pa.RecordBatch] = []  # rows of the run that is still open, without their text
        held: pa.Array | None = None  # its text
        more, goes_on = 0, False  # its rows so far, and whether a piece of it has gone out
        lowest: tuple | None = None  # of the texts that begin like the first one: digest and summary of the lowest digest
        highest: tuple | None = None  # of those that begin like the last one: the highest

        def shown(rows: pa.RecordBatch, text: pa.Array | None, starts: np.ndarray, heads: np.ndarray) -> pa.RecordBatch:
            n = len(rows)
            sizes = np.diff(np.append(starts, n))
            of = np.repeat(np.arange(len(starts)), sizes)
            head = np.zeros(n, dtype=bool)
            head[starts] = heads
            cols = {c: rows.column(c) for c in small}
            cols["keep_id"] = rows.column("_id").take(pa.array(starts[of]))
            cols |= {"_part": pa.array(np.full(n, part, dtype=np.int32)), "_run": pa.array(run + of), "group_size": pa.array(sizes[of]), "_head": pa.array(head), "_summary": pa.nulls(n, pa.string())}
            if body:
                cols["_body"] = text
            out = pa.RecordBatch.from_pydict({k: cols[k] for k in names})
            return out.filter(pa.array(head)) if heads_only else out

        def summary(number: int, text: pa.Array, digest: str, keep: pa.Array, size: int) -> pa.RecordBatch:
            cols = {"keep_id": keep, "_part": pa.array([part], pa.int32()), "_run": pa.array([number], pa.int64()), "group_size": pa.array([size], pa.int64()), "_head": pa.array([False]), "_summary": pa.array(text.to_pylist(), pa.string())}
            return pa.RecordBatch.from_pydict({k: cols[k] if k in cols else pa.nulls(1, kinds[k]) for k in names})

        def beside_edge(text: pa.Array, digests: pa.Array, keep: pa.Array, sizes: np.ndarray) -> None:
            """Note which of some runs, in order and numbered from ``run``, may be those at the edges."""
            nonlocal lowest, highest
            start = pc.utf8_slice_codeunits(text, 0, chars)
            one = lambda i: (run + i, pa.array(text[i : i + 1].to_pylist(), text.type), digests[i].as_py(), keep[i : i + 1].take(pa.array([0])), int(sizes[i]))
            first = start[0].as_py() if lowest is None else lowest[0]
            for i in np.flatnonzero(pc.equal(start, pa.scalar(first, start.type)).to_numpy(zero_copy_only=False))[: len(sizes) if lowest is None or start[0].as_py() == first else 0]:
                if lowest is None or digests[int(i)].as_py() < lowest[1][2]:
                    lowest = (first, one(int(i)))
            last = start[len(start) - 1].as_py()
            if highest is not None and highest[0] != last:
                highest = None
            for i in np.flatnonzero(pc.equal(start, pa.scalar(last, start.type)).to_numpy(zero_copy_only=False)):
                if highest is None or digests[int(i)].as_py() > highest[1][2]:
                    highest = (last, one(int(i)))

        def flush(closing: bool) -> Iterator[pa.RecordBatch]:
            """Hand on what waits of the open run."""
            nonlocal waiting, more, goes_on, run
            rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            text = None
            if body:
                at = np.zeros(len(rows), dtype=np.int64)
                text = held.take(pa.array(at)) if not heads_only else pa.array(held.to_pylist() + [None] * (len(rows) - 1), pa.string())
            yield shown(rows, text, np.zeros(1, dtype=np.int64), np.array([not goes_on]))
            keep = rows.column("_id")[:1]
            if closing and not goes_on:
                beside_edge(held, rows.column("_digest")[:1], keep, np.array([len(rows)]))
            else:
                yield summary(run, held, "", keep, len(rows))
            run, waiting, more, goes_on = run + 1, [], 0, not closing

        for batch in batches:
            if not len(batch):
                continue
            kinds = {f.name: f.type for f in batch.schema} | {"_body": pa.string()}
            text = batch.column("_text")
            rows = batch.select([c for c in batch.schema.names if c != "_text"])
            differs = pc.not_equal(text[1:], text[:-1]).to_numpy(zero_copy_only=False) if len(text) > 1 else np.zeros(0, dtype=bool)
            starts = np.concatenate([[0], np.flatnonzero(differs) + 1]).astype(np.int64)
            if held is not None:
                if text[0].as_py() == held[0].as_py():
                    cut = int(starts[1]) if len(starts) > 1 else len(text)
                    most = max(1, min(PIECE, PIECE_BYTES // (1 + pc.binary_length(held)[0].as_py()))) if body and not heads_only else PIECE
                    for k in range(0, cut, most):
                        waiting.append(rows.slice(k, min(most, cut - k)))
                        more += len(waiting[-1])
                        if more >= most and k + most < cut or more >= most and len(starts) == 1:
                            yield from flush(False)
                    if len(starts) == 1:
                        continue
                    rows, text, starts = rows.slice(cut), text[cut:], starts[1:] - cut
                if waiting:
                    yield from flush(True)
                goes_on = False
            cut = int(starts[-1])
            if cut:
                closed = starts[:-1]
                sizes = np.diff(starts)
                yield shown(rows.slice(0, cut), text[:cut], closed, np.ones(len(closed), dtype=bool))
                at = pa.array(closed)
                beside_edge(text.take(at), rows.column("_digest").take(at), rows.column("_id").take(at), sizes)
                run += len(closed)
            held = pa.array(text[cut : cut + 1].to_pylist(), text.type)  # a copy, which does not hold the batch
            waiting, more = [rows.slice(cut)], len(rows) - cut
        if held is not None:
            if waiting:
                yield from flush(True)
            for _, (number, text, digest, keep, size) in {e[1][0]: e for e in (lowest, highest) if e}.values():
                yield summary(number, text, digest, keep, size)

    return run_over


def content_sort(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = None,
    carry: tuple[str, ...] = (),
    kept_only: bool = False,
    splitter_chars: int = 48,
    partitions: int | None = None,
) -> DataFrame:
    """One row per row of ``docs`` (``kept_only``: per row that stays): id, keep_id, group_size, kept, text_sha256 (of the normalised text), and ``carry``."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    text = F.coalesce(F.col(text_col), F.lit(""))
    body = text_col in carry and not normalise  # the text that is sorted is the one to carry
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (normalise(text) if normalise else text).alias("_text"),
        *[F.col(text_col).isNull().alias(f"_c{i}") if body and c == text_col else F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)],
    ).withColumn("_digest", F.sha2(F.col("_text").cast("binary"), 256))
    by_id = F.asc_nulls_last("_id") if keep == "smallest" else F.desc_nulls_last("_id")
    n = partitions or shuffle_partitions(docs.sparkSession)
    kinds = dict(rows.dtypes)
    small = [c for c in rows.columns if c != "_text"]
    own = {"keep_id": kinds["_id"], "_part": "int", "_run": "long", "group_size": "long", "_head": "boolean", "_summary": "string"} | ({"_body": "string"} if body else {})
    schema = ", ".join(f"{c} {k}" for c, k in ({c: kinds[c] for c in small} | own).items())
    dealt = rows.repartitionByRange(n, F.substring("_text", 1, splitter_chars), "_digest", by_id).sortWithinPartitions("_text", by_id)
    marked = saved(dealt.mapInArrow(_runs(small, [*small, *own], splitter_chars, body, kept_only), schema), "content_sort")

    edges = marked.filter("_summary IS NOT NULL").select("_part", "_run", "_summary", "keep_id", "group_size")
    merged = edges.groupBy("_summary").agg(F.sum("group_size").alias("_total"), F.min(F.struct("_part", "_run", "keep_id")).alias("_first"))
    fixed = edges.join(merged, "_summary").select("_part", "_run", "_total", ((F.col("_first._part") == F.col("_part")) & (F.col("_first._run") == F.col("_run"))).alias("_starts"), F.col("_first.keep_id").alias("_keep"))
    fixed = saved(fixed, "content_sort_edges")  # two rows for each task and one for each piece, without the texts
    small_enough = fixed.count() <= BROADCAST_ROWS  # else texts are dealt out once more
    out = marked.filter("_summary IS NULL").drop("_summary").join(F.broadcast(fixed) if small_enough else fixed, ["_part", "_run"], "left")
    kept = F.col("_head") & F.coalesce("_starts", F.lit(True))
    name = lambda c: f"carried_{c}" if c in RESULT else c
    return (out.filter(kept) if kept_only else out).select(
        F.col("_id").alias(id_col),
        F.when(F.col("_total").isNull(), F.col("keep_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_total", "group_size").alias("group_size"),
        kept.alias("kept"),
        F.col("_digest").alias("text_sha256"),
        *[(F.when(~F.col(f"_c{i}"), F.col("_body")) if body and c == text_col else F.col(f"_c{i}")).alias(name(c)) for i, c in enumerate(carry) if c != id_col],
    )


def op10_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(table(spark, sf_dir, "documents"), keep="largest")


OP10_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
