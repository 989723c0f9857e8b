"""Packing of tokenised documents into sequences: best-two-fit.

Only lengths matter for a packing, so the plan is made on the histogram of
piece lengths, which has at most ``capacity`` entries whatever the corpus. A
sequence is filled greedily, the longest piece that fits first; when nothing
fits the gap any more, its smallest piece is taken out if two pieces not yet
packed fill the widened gap more tightly (a piece that is alone stays: taken out,
it would only be alone in another sequence). The pattern is repeated as often as
the counts allow, then the next one is made. Pieces are numbered within their
length by a range-partitioned sort, and the number says which sequence and
offset the plan gives them; no task sees more than its range.

Defined cases: a null text counts as empty; an empty text is one piece, the end
id alone; very long texts are cut into pieces, each of which is moved by itself;
repeated rows and null or repeated identifiers are packed row by row; pieces of
equal length are placed in the order of their rows; an empty table gives an
empty result; other columns, whatever their names, are ignored unless carried.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm.bpe import vocabulary
from keyfold.llm.shared import numbered, saved, table, whole_text
from keyfold.llm.words import encoder, grouped, slices, split


def plan(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths, each with the number of sequences that follow it; every piece is in one."""
    left = {n: c for n, c in counts.items() if c}
    lengths = sorted(left)
    made = []
    while lengths:
        use: Counter[int] = Counter()

        def largest(most: int) -> int | None:
            i = bisect_right(lengths, most) - 1
            while i >= 0 and left[lengths[i]] <= use[lengths[i]]:  # noqa: B023
                i -= 1
            return lengths[i] if i >= 0 else None

        pattern, gap = [], capacity
        while gap and (n := largest(gap)):
            pattern.append(n)
            use[n] += 1
            gap -= n
        if gap and len(pattern) > 1:
            small = pattern[-1]
            free = np.array([n for n in lengths[: bisect_right(lengths, gap + small)] if left[n] > use[n]], dtype=np.int64)
            if len(free):
                other = np.searchsorted(free, gap + small - free, side="right") - 1
                same = (other == np.arange(len(free))) & np.array([left[n] - use[n] < 2 for n in free.tolist()])
                other = other - same
                total = np.where(other >= 0, free + free[other], -1)
                best = int(total.argmax())
                if total[best] > small:
                    pattern[-1:] = sorted((int(free[best]), int(free[other[best]])), reverse=True)
        use = Counter(pattern)
        times = min(left[n] // k for n, k in use.items())
        made.append((pattern, times))
        for n, k in use.items():
            left[n] -= k * times
            if not left[n]:
                lengths.pop(bisect_right(lengths, n) - 1)
    return made


def placements(made: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For runs of pieces of one length: length, first rank, sequence of the first, offset (sorted by the first two)."""
    rank: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, times in made:
        offset = 0
        for n in pattern:
            rows.append((n, rank[n], sequence, offset))
            rank[n] += times
            offset += n
        sequence += times
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) if rows else tuple(np.zeros(0, dtype=np.int64) for _ in range(4))


def token_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, carried columns and ``ids`` (little-endian unsigned 32-bit) of every row; each task keeps a bounded table of words met."""
    rows = docs.select(F.col(id_col), *[c for c in carry if c not in (id_col, text_col)], whole_text(text_col).alias("_text"))
    others = rows.columns[:-1]

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, 1 << 18)
        for b in slices(batches, len(others), 3 << 20):
            words, starts = split(b.column(len(others)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], grouped(own.encode(words), starts).cast(pa.binary())], names=[*others, "ids"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(ids, ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", ids binary")


def pack(
    tokens: DataFrame,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    ids_col: str = "ids",
    keep: Callable[[Column], dict[str, Column]] | None = None,
) -> DataFrame:
    """Pieces of the rows of ``tokens`` with their sequence_id and offset.

    ``keep`` makes columns from a piece's ids, by default the ids themselves;
    what it does not keep is not written or shuffled.
    """
    end = F.lit(int(end_id).to_bytes(4, "little"))
    last = F.floor(F.octet_length("_ids") / (4 * capacity)).cast("int")  # the number of the last piece, which ends with the end id

    def piece(p: Column) -> Column:
        part = F.substring(F.col("_ids"), p * (4 * capacity) + 1, F.lit(4 * capacity))
        return F.struct(p.alias("piece"), F.when(p == last, F.concat(part, end)).otherwise(part).alias("part"))

    # each piece takes its own part along, not the ids of its whole document
    cut = tokens.select(F.col(id_col).alias("_id"), F.col(ids_col).alias("_ids"))
    cut = cut.select("_id", F.explode(F.transform(F.sequence(F.lit(0), last), piece)).alias("_p")).select("_id", "_p.piece", "_p.part")
    kept = keep(F.col("part")) if keep else {"ids": F.col("part")}
    pieces = saved(
        cut.select(
            F.col("_id").alias(id_col),
            "piece",
            (F.col("piece").cast("long") * capacity).alias("start"),
            (F.octet_length("part") / 4).cast("long").alias("length"),
            *[c.alias(n) for n, c in kept.items()],
            F.monotonically_increasing_id().alias("_row"),
        ),
        "pieces",
    )

    counts = {int(n): int(c) for n, c in pieces.groupBy("length").count().collect()}  # at most capacity rows
    length, rank, sequence, offset = placements(plan(counts, capacity))
    first = np.zeros(capacity + 2, dtype=np.int64)  # pieces that are shorter
    for n, c in counts.items():
        first[n + 1] += c
    first = np.cumsum(first)
    top = max(1, sum(counts.values()))
    key = length * top + rank

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, no = b.column(1).to_numpy(), b.column(2).to_numpy()
            own = no - first[n]
            at = np.searchsorted(key, n * top + own, side="right") - 1
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sequence[at] + own - rank[at]), pa.array(offset[at])], names=["_row", "sequence_id", "offset"])

    at = numbered(pieces.select("_row", "length"), ["length", "_row"]).select("_row", "length", "row_no").mapInArrow(placed, "_row long, sequence_id long, offset long")
    return pieces.join(at, "_row").drop("_row")


def op9_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = token_ids(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pack(tokens, keep=lambda ids: {"ids_crc32": F.crc32(ids)}).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
