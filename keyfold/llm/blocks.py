"""Exact top-k search by integer inner product with block-at-a-time pruning.

Vectors are put in an order that keeps like vectors together (nearest of a few
centres, then identifier) and cut into document-range blocks. A block keeps its
vectors as one matrix (the forward index) and, for each component, the largest
and smallest value. For a query the sum over components of the larger product
bounds every score in a block. Neighbouring blocks form chunks, each the work of
a task, with bounds of their own; there are about ``chunks`` of them until one
would hold more than ``most_blocks``, so that every task can have the bounds of
all. A query first goes to the chunk of the highest bound, where blocks are
taken by falling bound and scored through their matrix until the next bound
falls below its k-th score. Then, with that k-th score, it goes to those other
chunks only whose bound reaches it, and the same happens there. A bounded sample
of the vectors gives each query a k-th score to start from, which is at most the
true one. Chunks that many queries ask are given to several tasks.

Defined cases: vectors that are null or hold a null or non-finite component take
no part; a vector is compared with those of its own length only; ties go to the
smaller identifier; rows that repeat a vector or an identifier are candidates
like any other, and only the query's own row is left out; null identifiers are
never queries and come last among ties; an empty table gives an empty result;
other columns are ignored. Scores are exact; one that does not fit 64 bits is
given as the largest or smallest long, and such scores tie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyfold.llm.shared import dropped, numbered, saved, table

NULL_ID = np.iinfo(np.int64).max
LEAST = np.iinfo(np.int64).min
FOUND = "q_row long, query_id long, vec_id long, score long, blocks int"


def product(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact products of integers held as doubles; by floating point where that is exact."""
    most = float(np.abs(q).max()) * float(np.abs(m).max()) * q.shape[1] if q.size and m.size else 0.0
    if most < 2**52:
        return (q @ m.T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ m.astype(np.int64).T
    whole = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
    return np.clip(whole(q) @ whole(m).T, -int(NULL_ID), int(NULL_ID)).astype(np.int64)


def bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """No score of a row of ``q`` in a block is above this, rounding and the limits of 64 bits included."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    size = np.maximum(np.abs(high), np.abs(low))
    return np.maximum(up @ high.T + down @ low.T + 1e-9 * ((up - down) @ size.T), float(LEAST))


def _integers(scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                if v.is_valid and not v.values.null_count:
                    x = np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=np.float64)
                    if np.isfinite(x).all():
                        x = np.floor(scale * x)
                        ids.append(i)
                        out.append((len(x), x.astype("<i2" if len(x) and np.abs(x).max() < 1 << 15 else "<f8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([n for n, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["id", "dim", "v"])

    return run


def _matrix(column, dim: int) -> np.ndarray:
    """Vectors kept as 16-bit integers, or as doubles where these are too small, as one matrix of doubles."""
    rows = column.to_pylist()
    if all(len(r) == 2 * dim for r in rows):
        return np.frombuffer(b"".join(rows), "<i2").reshape(len(rows), dim).astype(np.float64)
    return np.stack([np.frombuffer(r, "<i2" if len(r) == 2 * dim else "<f8").astype(np.float64) for r in rows])


def _stored(m: np.ndarray) -> bytes:
    return m.astype("<i2" if m.size and np.abs(m).max() < 1 << 15 else "<f8").tobytes()


def _loaded(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i2" if len(data) == 2 * rows * dim else "<f8").reshape(rows, dim).astype(np.float64)


def _centres(sample: list[tuple[int, np.ndarray]], most: int = 64, rounds: int = 6) -> dict[int, np.ndarray]:
    """A few centres for each vector length, from a bounded sample."""
    out = {}
    for dim in {d for d, _ in sample}:
        x = np.stack([v for d, v in sample if d == dim])
        c = x[:most]
        for _ in range(rounds if dim else 0):
            near = (x @ c.T - 0.5 * (c**2).sum(axis=1)).argmax(axis=1)
            c = np.stack([x[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        out[dim] = c
    return out


def _search(k: int):
    """The best ``k`` of a chunk's blocks for each query, and how many blocks were scored."""

    def run(b: pa.Table, q: pa.Table) -> pa.Table:
        if not len(b) or not len(q):
            return pa.table({"q_row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "blocks": pa.array([], pa.int32())})
        b = b.sort_by("group")
        dim = q.column("dim")[0].as_py()
        qs = _matrix(q.column("v"), dim)
        q_ids, q_rows, least = (q.column(c).to_numpy() for c in ("query_id", "q_row", "least"))
        index = []
        for i in range(len(b)):
            ids, at = (np.frombuffer(b.column(c)[i].as_py(), "<i8") for c in ("ids", "rows"))
            index.append((ids, at, b.column("m")[i]))
        high, low = (np.stack([np.frombuffer(x.as_py(), "<f8") for x in b.column(c)]) for c in ("high", "low"))
        bound = bounds(qs, high, low)
        best = np.full((len(qs), k), LEAST)
        best_id = np.full((len(qs), k), NULL_ID)
        filled = np.zeros((len(qs), k), dtype=bool)
        scored = np.zeros(len(qs), dtype=np.int32)
        ranks = np.argsort(-bound, axis=1, kind="stable")
        for r in range(len(index)):
            now = ranks[:, r]
            kth = np.where(filled[:, -1], np.maximum(least, best[:, -1]), least)
            active = bound[np.arange(len(qs)), now] >= kth
            if not active.any():
                break
            scored += active
            for j in np.unique(now[active]):
                who = np.flatnonzero(active & (now == j))
                ids, at, m = index[j]
                scores = product(qs[who], _loaded(m.as_py(), len(ids), dim))
                ok = (at[None, :] != q_rows[who][:, None]) & (scores >= kth[who][:, None])
                some = ok.any(axis=1)  # most blocks after the first few change nothing for most queries
                if not some.any():
                    continue
                who, scores, ok = who[some], scores[some], ok[some]
                all_s = np.concatenate([best[who], scores], axis=1)
                all_i = np.concatenate([best_id[who], np.broadcast_to(ids, scores.shape)], axis=1)
                all_f = np.concatenate([filled[who], ok], axis=1)
                top = np.lexsort((all_i, -all_s, ~all_f), axis=-1)[:, :k]
                best[who], best_id[who], filled[who] = (np.take_along_axis(x, top, axis=1) for x in (all_s, all_i, all_f))
        n = filled.sum(axis=1)
        return pa.table({"q_row": np.repeat(q_rows, n), "query_id": np.repeat(q_ids, n), "vec_id": best_id[filled], "score": best[filled], "blocks": np.repeat(scored, n)})

    return run


def found(
    vectors: DataFrame,
    k: int = 20,
    query_mod: int = 20,
    scale: int = 64,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = 256,
    chunk: int = 16,
    chunks: int = 32,
    most_blocks: int = 1024,
    sample: int = 2048,
    per_task: int = 8192,
) -> DataFrame:
    """q_row, query_id, vec_id (the largest long for null), score and blocks (scored for the query in that chunk) of every chunk's best."""
    spark = vectors.sparkSession
    rows = saved(vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(_integers(scale), "id long, dim int, v binary"), "vectors")
    some = [(r.dim, _matrix(pa.array([bytes(r.v)]), r.dim)[0], r.id) for r in rows.orderBy(F.xxhash64("v", "id")).limit(sample).collect()]
    centres = _centres([s[:2] for s in some])
    own = {d: (np.stack([v for n, v, _ in some if n == d]), np.array([NULL_ID if i is None else i for n, _, i in some if n == d])) for d in centres}

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, cell = b.column(1).to_numpy(), np.zeros(len(b), dtype=np.int32)
            for d in np.unique(dims):
                if d in centres and d:
                    at = np.flatnonzero(dims == d)
                    c = centres[d]
                    x = _matrix(b.column(2).take(pa.array(at)), d)
                    cell[at] = (x @ c.T - 0.5 * (c**2).sum(axis=1)).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], names=["id", "dim", "v", "cell"])

    order = ["dim", "cell", F.asc_nulls_last("id"), "v"]
    placed = saved(numbered(rows.mapInArrow(celled, "id long, dim int, v binary, cell int"), order), "placed")
    last = placed.agg(F.max("row_no")).first()[0]
    size = min(most_blocks, max(chunk, -(-((last or 0) // block + 1) // chunks)))

    def packed(t: pa.Table) -> pa.Table:
        dim, group = t.column("dim")[0].as_py(), t.column("group")[0].as_py()
        t = t.sort_by("row_no")
        m = _matrix(t.column("v"), dim)
        ids = t.column("id").fill_null(NULL_ID).to_numpy().astype("<i8")
        edge = lambda f: [f(m, axis=0).astype("<f8").tobytes()]
        return pa.table({"dim": pa.array([dim], pa.int32()), "group": [group], "ids": [ids.tobytes()], "rows": [t.column("row_no").to_numpy().astype("<i8").tobytes()], "m": [_stored(m)], "high": edge(np.max), "low": edge(np.min)})

    blocks = placed.withColumn("group", F.expr(f"row_no div {block}")).groupBy("dim", "group").applyInArrow(packed, "dim int, group long, ids binary, rows binary, m binary, high binary, low binary")
    blocks = saved(blocks.withColumn("chunk", F.expr(f"group div {size}")), "blocks")

    def summed(t: pa.Table) -> pa.Table:
        edge = lambda c, f: [f(np.stack([np.frombuffer(x.as_py(), "<f8") for x in t.column(c)]), axis=0).tobytes()]
        return pa.table({"dim": t.column("dim")[:1], "chunk": t.column("chunk")[:1], "high": edge("high", np.max), "low": edge("low", np.min)})

    # one row for each chunk: some ``chunks``, and one more for each vector length
    got = blocks.select("dim", "chunk", "high", "low").groupBy("dim", "chunk").applyInArrow(summed, "dim int, chunk long, high binary, low binary").collect()
    edges = {d: tuple(np.stack([np.frombuffer(bytes(r[c]), "<f8") for r in got if r.dim == d]) for c in ("high", "low")) for d in {r.dim for r in got}}
    names = {d: np.array([r.chunk for r in got if r.dim == d]) for d in edges}

    def start(qs: np.ndarray, ids: np.ndarray, dim: int) -> np.ndarray:
        """A k-th score to start from."""
        s, s_ids = own.get(dim, (np.zeros((0, dim)), np.zeros(0, dtype=np.int64)))
        if len(s) <= k:
            return np.full(len(qs), LEAST)
        # the query's own row may be in the sample: then one more is needed
        ranked = -np.sort(-product(qs, s), axis=1)
        return ranked[np.arange(len(qs)), np.minimum(np.where(np.isin(ids, s_ids), k + 1, k), len(s)) - 1]

    def asking(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                dims = b.column(0).to_numpy()
                for d in np.unique(dims):
                    at = np.flatnonzero(dims == d)
                    part = b.take(pa.array(at))
                    qs = _matrix(part.column(3), d)
                    bound = bounds(qs, *edges[d])
                    if first:
                        least, to = start(qs, part.column(2).to_numpy(), d), bound.argmax(axis=1)
                        who = np.arange(len(qs))
                    else:
                        least, seen = part.column(4).to_numpy(), part.column(5).to_numpy()
                        who, to = np.nonzero((bound >= least[:, None]) & (names[d][None, :] != seen[:, None]))
                    sent = part.select(range(4)).take(pa.array(who))
                    yield pa.RecordBatch.from_arrays([*sent.columns, pa.array(least[who]), pa.array(names[d][to])], names=["dim", "q_row", "query_id", "v", "least", "chunk"])

        return run

    asks = "dim int, q_row long, query_id long, v binary, least long, chunk long"

    def answers(asked: DataFrame) -> DataFrame:
        tasks = [(r.dim, r.chunk, -(-r["count"] // per_task)) for r in asked.groupBy("dim", "chunk").count().collect()]
        parts = F.broadcast(spark.createDataFrame(tasks, "dim int, chunk long, parts long"))  # as bounded as the chunks
        right = asked.join(parts, ["dim", "chunk"]).withColumn("part", F.pmod(F.xxhash64("q_row"), "parts")).drop("parts")
        left = blocks.join(parts, ["dim", "chunk"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        keys = ["dim", "chunk", "part"]
        return saved(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_search(k), FOUND), "found")

    queries = placed.filter(F.col("id") % query_mod == 0).select("dim", F.col("row_no").alias("q_row"), F.col("id").alias("query_id"), "v")
    asked = saved(queries.mapInArrow(asking(True), asks), "asked")
    best = answers(asked)
    kth = best.groupBy("q_row").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    again = asked.join(kth, "q_row", "left").select("dim", "q_row", "query_id", "v", F.greatest("least", "kth").alias("least"), "chunk")
    again = saved(again.mapInArrow(asking(False), asks), "asked")
    more = answers(again)
    dropped(rows, placed, blocks, asked, again)
    return best.unionByName(more)


def top_k(vectors: DataFrame, k: int = 20, **options) -> DataFrame:
    """query_id, rank, vec_id, score; ``options`` as in :func:`found`."""
    rank = F.row_number().over(W.partitionBy("q_row").orderBy(F.desc("score"), F.asc("vec_id")))
    out = found(vectors, k, **options).withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("query_id", "rank", F.when(F.col("vec_id") != int(NULL_ID), F.col("vec_id")).alias("vec_id"), "score")


def op6_block_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
