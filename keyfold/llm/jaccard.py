"""Near-duplicate join on sets of word n-grams with an exact Jaccard threshold.

Rare-first prefix filtering. A document's set is ordered by how common its
n-grams are, and only the first ``n - ceil(t n) + 1`` of the n in the set (its
prefix) are joined: two sets that reach the threshold share one of them. How
common an n-gram is is counted over all documents, in full for a fixed part of
the n-grams (those whose hash is low; a prefix seldom needs others) and by its
repeats within slices of the corpus for the rest, and the ``heavy`` most common of those counted ``heavy_from`` times or more go to every
task; any order that is the same everywhere keeps the join exact.

Documents with equal sets form a class and are joined as one. Within the
documents that share a prefix n-gram, pairs are not all made. Postings are
dealt by n-gram (a very common one also by a salt) and sorted; one pass pairs
each set with the centre of its run, the set with the fewest n-grams of its own.
Links are verified and components formed. Where an n-gram's sets are still in
several components, those outside the largest one are paired with a few more
centres from it, as long as that joins many of them. What is outside even then
is paired with the sets of other components, each pair once: it is made by the
first of the n-grams that the heads of both prefixes show. Sets whose length
and position rule out all others of a small run are left out before that.
Pairs must pass the length and positional filters and, as suffix filters, two
bounds on the n-grams in which the sets differ (256 parity bits where what is
left is paired, counts in 256 hash ranges of each set for all); the texts of those that are left are joined, and
each pair is verified once by its exact overlap. A set with very many pairs
meets them in several tasks, its text once in each.

N-grams are compared by 64-bit hashes, as are the components within a prefix
n-gram's documents. ``docs`` is read several times and so should be a table, not
a computation. Defined cases: a text with fewer words than n is one n-gram as a
whole; null texts, empty texts and texts without words have an empty set, size
0, and link with nothing; very long texts are worked on whole, one at a time;
repeated rows are in one class; identifiers may repeat or be null: links follow
texts, a row with a null identifier is in the component of its text, and a
component's identifier is the smallest that is not null; an empty table gives an
empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from keyfold.llm.components import components
from keyfold.llm.features import A1, A2
from keyfold.llm.shared import dropped, saved, table, whole_text
from keyfold.llm.words import slices

BITS = ("p0", "p1", "p2", "p3")  # parity bits
CENTRES = 8  # more centres of an n-gram in one turn
TURNS = 1
HEAD = 8  # n-grams by which a pair is recognised as made before
SALTS = 16  # tasks over which one set's pairs are dealt
RUN = 1 << 16  # uses of an n-gram that get a centre of their own
GROUP = 1 << 12  # sets of an n-gram in one task when what is left is paired
SMALL = 128  # sets of a run that are held against each other at once
BROADCAST_ROWS = 200_000  # rows of three integers
SLICE = 4 << 20


def _mix(z: np.ndarray, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        z = (z + np.uint64(salt)) * A1
        z = (z ^ (z >> np.uint64(32))) * A2
        return z ^ (z >> np.uint64(29))


def sets(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each row, ascending within the row, and where each row's start."""
    text = text.cast(pa.large_string()).take(pa.array(np.arange(len(text))))
    parts = pc.ascii_split_whitespace(pc.ascii_lower(text))
    starts = parts.offsets.to_numpy().astype(np.int64)
    words = parts.flatten().dictionary_encode()
    rows = len(text)
    if not len(words):
        return np.zeros(0, dtype=np.uint64), np.zeros(rows + 1, dtype=np.int64)
    names = words.dictionary.cast(pa.large_binary()).to_pylist()
    of = np.fromiter(map(xxhash.xxh3_64_intdigest, names), dtype=np.uint64, count=len(names))
    full = np.fromiter(map(bool, names), dtype=bool, count=len(names))
    at = words.indices.to_numpy()
    keep = full[at]
    row = np.repeat(np.arange(rows), np.diff(starts))[keep]
    h = of[at][keep]
    count = np.bincount(row, minlength=rows)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    with np.errstate(over="ignore"):
        gram, whole = h[: len(h) - n + 1].copy(), len(h) - n + 1
        if whole > 0:
            for k in range(1, n):
                gram = _mix(gram) * A1 + h[k : whole + k]
            same = row[: len(gram)] == row[n - 1 :]
            gram, row_of = _mix(gram[same], n), row[: len(gram)][same]
        else:
            gram, row_of = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            value = np.zeros(len(short), dtype=np.uint64)
            for k in range(n - 1):
                more = count[short] > k
                value[more] = _mix(value[more]) * A1 + h[first[short[more]] + k]
            gram = np.concatenate([gram, _mix(value, 1_000_003) ^ count[short].astype(np.uint64)])
            row_of = np.concatenate([row_of, short])
    starts = np.searchsorted(row_of, np.arange(rows + 1)) if not len(short) else None
    if starts is None:  # the rows of few words came last
        order = np.argsort(row_of, kind="stable")
        gram, row_of = gram[order], row_of[order]
        starts = np.searchsorted(row_of, np.arange(rows + 1))
    for i, j in zip(starts[:-1].tolist(), starts[1:].tolist()):
        gram[i:j].sort()
    new = np.ones(len(gram), dtype=bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row_of[1:] != row_of[:-1])
    return gram[new], np.concatenate([[0], np.cumsum(new)])[starts]


def signatures(gram: np.ndarray, starts: np.ndarray, many: int = 2) -> list[np.ndarray]:
    """64-bit sums that tell sets apart."""
    out = []
    for salt in range(11, 11 + many):
        total = np.zeros(len(starts) - 1, dtype=np.uint64)
        full = np.flatnonzero(np.diff(starts))
        if len(full):
            with np.errstate(over="ignore"):
                total[full] = np.add.reduceat(_mix(gram, salt), starts[full])
        out.append(_mix(total).view(np.int64))
    return out


def sketches(gram: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """256 parity bits of each set, as four integers: two sets differ in at least as many n-grams as bits."""
    bit = np.uint64(1) << ((gram >> np.uint64(56)) & np.uint64(63))
    word = gram >> np.uint64(62)
    out = []
    full = np.flatnonzero(np.diff(starts))
    for k in range(4):
        parity = np.zeros(len(starts) - 1, dtype=np.uint64)
        if len(full):
            parity[full] = np.bitwise_xor.reduceat(np.where(word == np.uint64(k), bit, np.uint64(0)), starts[full])
        out.append(parity.view(np.int64))
    return out


def histograms(gram: np.ndarray, starts: np.ndarray) -> pa.Array:
    """How many n-grams of each set fall into each of 256 hash ranges, a byte each: sets differ in at least the sum of differences."""
    rows = len(starts) - 1
    cell = np.repeat(np.arange(rows), np.diff(starts)) << 8 | (gram >> np.uint64(56)).astype(np.int64)
    counts = np.minimum(np.bincount(cell, minlength=rows << 8), 255).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(0, (rows << 8) + 1, 256, dtype=np.int32)), pa.py_buffer(counts)])


def _need(size: np.ndarray, percent: int) -> np.ndarray:
    return -(-percent * size // 100)


class Order:
    """The order of n-grams that every task shares: a class of commonness (6 bits), then the hash."""

    def __init__(self, low: np.uint64, heavy: np.ndarray, counts: np.ndarray):
        self.low, self.heavy, self.counts = low, heavy, counts
        self.level = np.minimum(63, 2 + 2 * np.log2(np.maximum(counts, 1))).astype(np.uint64)
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[heavy >> np.uint64(42)] = True

    def salts(self, gram: np.ndarray, node: np.ndarray) -> np.ndarray:
        """0 for n-grams of ``RUN`` uses or fewer; others are dealt to as many runs as they need, by the set."""
        out = np.zeros(len(gram), dtype=np.int64)
        if len(self.heavy):
            found = np.minimum(np.searchsorted(self.heavy, gram), len(self.heavy) - 1)
            runs = np.minimum(-(-self.counts[found] // RUN), 0xFFFF)
            at = np.flatnonzero((self.heavy[found] == gram) & (runs > 1))
            out[at] = 1 + _mix(node[at].view(np.uint64), 5).astype(np.int64) % runs[at]
        return out

    def keys(self, gram: np.ndarray) -> np.ndarray:
        level = np.where(gram < self.low, np.uint64(0), np.uint64(1))
        at = np.flatnonzero(self.maybe[gram >> np.uint64(42)])
        if len(at):
            found = np.minimum(np.searchsorted(self.heavy, gram[at]), len(self.heavy) - 1)
            hit = self.heavy[found] == gram[at]
            level[at[hit]] = self.level[found[hit]]
        return (level << np.uint64(58)) | (gram >> np.uint64(6))


def prefixes(gram: np.ndarray, starts: np.ndarray, percent: int, order: Order) -> tuple[np.ndarray, ...]:
    """Row, n-gram and position of each row's prefix, and how many of it are not heavy."""
    size = np.diff(starts)
    key = order.keys(gram)
    length = np.where(size > 0, size - _need(size, percent) + 1, 0)
    picked = []
    for i, j, p in zip(starts[:-1].tolist(), starts[1:].tolist(), length.tolist()):
        if j > i:
            k = key[i:j]
            part = np.argpartition(k, p - 1)[:p] if p < j - i else np.arange(j - i)
            picked.append(part[np.argsort(k[part], kind="stable")] + i)
    at = np.concatenate([np.zeros(0, dtype=np.int64), *picked])
    row = np.repeat(np.arange(len(size)), length)
    position = np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)
    light = np.bincount(row, (key[at] >> np.uint64(58)) < 2, minlength=len(size)).astype(np.int64)
    return row, gram[at], position, light


def heavy_ngrams(rows: DataFrame, n: int, low: np.uint64, heavy_from: int, heavy: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``heavy`` most common n-grams (all, if fewer) with their counts over all texts.

    Below ``low`` every occurrence counts; above it those in slices of the
    corpus that hold the n-gram more than once, which is where very common
    lines and passages show.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0, SLICE):
            gram, _ = sets(b.column(0), n)
            found, c = np.unique(gram, return_counts=True)
            told = (found < low) | (c > 1)
            yield pa.RecordBatch.from_arrays([pa.array(found[told].view(np.int64)), pa.array(c[told])], names=["g", "c"])

    counts = rows.select("text").mapInArrow(counted, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")).filter(F.col("c") >= heavy_from)
    counts = saved(counts.withColumn("bin", F.floor(F.log2("c") * 8)), "heavy")
    room, wanted = heavy, F.lit(False)
    for bin_, many in sorted(map(tuple, counts.groupBy("bin").count().collect()), reverse=True):  # a few hundred bins
        share = F.lit(True) if many <= room else F.pmod(F.xxhash64("g"), F.lit(1 << 20)) < int((room << 20) / many * 0.99)
        wanted, room = wanted | ((F.col("bin") == bin_) & share), room - many
        if room <= 0:
            break
    got = counts.filter(wanted).select("g", "c").toArrow()
    dropped(counts)
    g, c = got.column("g").to_numpy().view(np.uint64), got.column("c").to_numpy()
    order = np.argsort(g)
    return g[order], c[order]


def hopeful(starts: np.ndarray, sizes: np.ndarray, n: np.ndarray, at: np.ndarray, percent: int) -> np.ndarray:
    """The rows that the length and positional filters leave a link with another row of their run, its first one (the centre) apart."""
    out = np.zeros(len(n), dtype=bool)
    end = np.repeat(starts + sizes, sizes)
    i = np.setdiff1d(np.arange(len(n)), starts, assume_unique=True)
    for d in range(1, len(n)):
        i = i[i + d < end[i]]
        if not len(i):
            break
        j = i + d
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        ok = np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent
        ok &= np.minimum(at[i], at[j]) + 1 + np.minimum(n[i] - at[i], n[j] - at[j]) - 1 >= need
        out[i[ok]] = out[j[ok]] = True
    return out


def met(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Postings (g, node, n_at, own_salt) in the order of g, salt, own, node, as members of the runs of equal g and salt.

    The first set of a run, which has the fewest n-grams of its own, is its
    centre. ``star``: the filters leave a link with it possible. ``many``: the
    n-gram may have pairs that no centre is in, as it has three sets or more or
    is dealt out by salts. Only the centre and two rows are kept between batches.
    """
    none = np.zeros(0, dtype=np.int64)
    held, centre = (none,) * 4, None  # rows whose run may still turn out to be short; the centre of a run that did not

    def told(g, node, n_at, own, last: bool):
        nonlocal held, centre
        salt = own & 0xFFFF
        new = np.ones(len(g), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (salt[1:] != salt[:-1])
        fresh = new.copy()
        fresh[1:] |= node[1:] != node[:-1]
        if centre and len(g) and (g[0], salt[0]) == centre[0] and node[0] == centre[2]:
            fresh[0] = False
        g, node, n_at, salt, own, new = (x[fresh] for x in (g, node, n_at, salt, own, new))
        if not len(g):
            return None
        new[0] = True
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(g)))
        of = np.repeat(np.arange(len(starts)), sizes)
        node_c, n_c = node[starts], n_at[starts].copy()
        many = (sizes > 2) | (salt[starts] > 0)
        shown = (sizes > 1) | many
        if centre and (g[0], salt[0]) == centre[0]:
            node_c[0], n_c[0] = centre[1]
            many[0] = shown[0] = True
        if last or many[-1]:
            held = (none,) * 4
            centre = ((g[-1], salt[-1]), (node_c[-1], n_c[-1]), node[-1]) if not last else None
        else:
            k = starts[-1]
            held, centre = tuple(x[k:] for x in (g, node, n_at, own)), None
            shown[-1] = False
        n, at, nc, ac = n_at >> 32, n_at & 0xFFFFFFFF, (n_c >> 32)[of], (n_c & 0xFFFFFFFF)[of]
        need = -(-percent * (n + nc) // (100 + percent))
        star = (node != node_c[of]) & (np.minimum(n, nc) * 100 >= np.maximum(n, nc) * percent)
        star &= np.minimum(at, ac) + 1 + np.minimum(n - at - 1, nc - ac - 1) >= need
        keep = shown[of] & (star | many[of])
        cols = [g[keep], node[keep], n[keep].astype(np.int32), at[keep].astype(np.int32), node_c[of][keep], star[keep], many[of][keep], salt[keep]]
        return pa.RecordBatch.from_arrays(list(map(pa.array, cols)), names=["g", "node", "n", "at", "node_c", "star", "many", "salt"])

    for b in batches:
        if len(b):
            out = told(*(np.concatenate([h, b.column(i).to_numpy()]) for i, h in enumerate(held)), last=False)
            if out is not None and len(out):
                yield out
    out = told(*held, last=True)
    if out is not None and len(out):
        yield out


def narrowed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """What :func:`met` gives without the sets that cannot have a link by their n-gram: in a run of ``SMALL`` sets or fewer
    that has all of the n-gram's and is whole in a batch, all are held against each other. The centre has met all of them."""
    for b in batches:
        g, node, n, at, node_c, star, many, salt = (c.to_numpy(zero_copy_only=False) for c in b.columns)
        starts = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (salt[1:] != salt[:-1])))
        sizes = np.diff(np.append(starts, len(g)))
        small = many[starts] & (sizes <= SMALL) & (salt[starts] == 0)
        small[[0, -1]] = False  # may go on in other batches
        among, more = np.repeat(small, sizes), many.copy()
        more[among] = hopeful(np.cumsum(sizes[small]) - sizes[small], sizes[small], n[among].astype(np.int64), at[among].astype(np.int64), percent)
        keep = star | more
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (g, node, n, at, node_c, star, more)], names=["g", "node", "n", "at", "node_c", "star", "many"])


def beside(pairs: DataFrame, key: str, other: str, values: DataFrame) -> DataFrame:
    """``pairs`` with the columns of ``values`` for ``key``, which may be the same in very many pairs: they meet by key and a salt from the other side."""
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64(other), F.lit(SALTS)).cast("int"))
    wanted = salted.select(key, "_salt").distinct().join(values, key)
    return salted.join(wanted, [key, "_salt"]).drop("_salt")


def near_enough(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of nodes (x, y) as pairs of classes (a, b), without those whose histograms rule the threshold out."""
    one = lambda node, c: classes.select(F.col("node").alias(node), F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("hist").alias(f"h_{c}"))
    rows = beside(beside(pairs, "y", "x", one("y", "b")), "x", "y", one("x", "a")).filter("a <> b").select("a", "b", "n_a", "n_b", "h_a", "h_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, len(whole), 4096):
                b = whole.slice(k, 4096)
                na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
                ha, hb = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(len(b), 256).astype(np.int16) for c in (4, 5))
                need = -(-percent * (na + nb) // (100 + percent))
                keep = pa.array(np.abs(ha - hb).sum(axis=1) <= na + nb - 2 * need)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return rows.mapInArrow(check, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets reach the threshold; ``texts``: class, text.

    The text of ``a`` comes once for each salt, before those of the ``b`` it is compared with.
    """
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    text = lambda c: texts.select(F.col("class").alias(c), "text")
    first = salted.select("a", "_salt").distinct().join(text("a"), "a").select("a", "_salt", F.lit(None).cast("long").alias("b"), "text")
    both = first.unionByName(salted.join(text("b"), "b").select("a", "_salt", "b", "text"))
    both = both.repartition("a", "_salt").sortWithinPartitions("a", "_salt", F.asc_nulls_first("b")).select("a", "b", "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = np.zeros(0, dtype=np.uint64)
        for b in slices(batches, 2, 3 << 20):
            gram, starts = sets(b.column(2), n)
            centre = b.column(1).is_null().to_numpy(zero_copy_only=False)
            ok = np.zeros(len(b), dtype=bool)
            for i in range(len(b)):
                y = gram[starts[i] : starts[i + 1]]
                if centre[i]:
                    x = y.copy()
                    continue
                need = -(-percent * (len(x) + len(y)) // (100 + percent))
                if min(len(x), len(y)) < need or not need:
                    continue
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                ok[i] = int((x[at] == y).sum()) >= need
            mask = pa.array(ok)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    return both.mapInArrow(check, "a long, b long")


def row_keys(id_col: str, text: Column) -> list[Column]:
    """128 bits that tell rows by identifier and text."""
    return [F.xxhash64(F.lit(k), F.col(id_col), text).alias(f"k{k}") for k in (1, 2)]


def grouped_rows(docs: DataFrame, n: int, percent: int, id_col: str, text_col: str, heavy_from: int, heavy: int) -> DataFrame:
    """For every row: id, k1, k2 (see :func:`row_keys`), n, class_id, component (a number, null without n-grams), component_id."""
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("id"), *row_keys(id_col, text), text.alias("text"))
    kind = dict(rows.dtypes)["id"]
    low = np.uint64(min(2**64 - 1, int(2**64 * 2.5 * (100 - percent) / 100)))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 3, SLICE):
            gram, starts = sets(b.column(3), n)
            s, t = signatures(gram, starts)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *map(pa.array, (np.diff(starts), s, t, *sketches(gram, starts))), histograms(gram, starts)], names=["id", "k1", "k2", "n", "node", "check", *BITS, "hist"])

    all_rows = saved(rows.mapInArrow(described, f"id {kind}, k1 long, k2 long, n long, node long, check long, " + ", ".join(f"{k} long" for k in BITS) + ", hist binary"), "sets")
    # a class is the rows of one set; its number is written once
    classes = all_rows.filter("n > 0").groupBy("n", "node", "check").agg(F.min("id").alias("class_id"), F.min(F.struct("k1", "k2")).alias("k"), *[F.first(k).alias(k) for k in (*BITS, "hist")])
    classes = saved(classes.withColumn("class", F.monotonically_increasing_id()), "classes")

    g, c = heavy_ngrams(rows, n, low, heavy_from, heavy)
    sent = docs.sparkSession.sparkContext.broadcast((g, c))

    def prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = Order(low, *sent.value)
        for b in slices(batches, 0, SLICE):
            gram, starts = sets(b.column(0), n)
            node = signatures(gram, starts, 1)[0]
            size = np.diff(starts)
            row, value, position, light = prefixes(gram, starts, percent, order)
            first = np.zeros(len(size), dtype=bool)
            first[np.unique(node, return_index=True)[1]] = True  # equal sets of a slice once
            k = first[row]
            row, value = row[k], value[k]
            own = (light[row] << 16) | order.salts(value, node[row])
            yield pa.RecordBatch.from_arrays(list(map(pa.array, (value.view(np.int64), node[row], (size[row] << 32) | position[k], own))), names=["g", "node", "n_at", "own"])

    postings = rows.select("text").mapInArrow(prefixed, "g long, node long, n_at long, own long")
    salt = F.col("own").bitwiseAND(F.lit(0xFFFF))
    postings = postings.repartition(F.col("g"), salt).sortWithinPartitions("g", salt, "own", "node")
    shared = saved(postings.mapInArrow(lambda b: narrowed(met(b, percent), percent), "g long, node long, n int, at int, node_c long, star boolean, many boolean"), "postings")

    def possible(n1: str, at1: str, n2: str, at2: str) -> Column:
        long_, short = F.greatest(n1, n2), F.least(n1, n2)
        need = F.ceil((F.col(n1) + F.col(n2)) * percent / (100 + percent) - 1e-9)
        most = F.least(at1, at2) + 1 + F.least(F.col(n1) - F.col(at1) - 1, F.col(n2) - F.col(at2) - 1)
        return (short * 100 >= long_ * percent) & (most >= need)

    def near(n1: str, bits1: list[str], n2: str, bits2: list[str]) -> Column:
        """Whether the parity bits leave the threshold possible: at most n1 + n2 - 2 * overlap n-grams differ."""
        differ = sum((F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(bits1, bits2)), F.lit(0))
        need = F.ceil((F.col(n1) + F.col(n2)) * percent / (100 + percent) - 1e-9)
        return differ <= F.col(n1) + F.col(n2) - 2 * need

    def linked(pairs: DataFrame) -> DataFrame:
        """Links (a, b) of classes among pairs of nodes (x, y)."""
        pairs = saved(pairs.distinct(), "met")
        likely = saved(near_enough(pairs, classes, percent), "pairs")
        dropped(pairs)
        if not some(likely):
            return likely
        seen = likely.select(F.col("a").alias("class")).union(likely.select("b")).distinct().join(classes.select("class", "k.k1", "k.k2"), "class")
        seen = saved(seen, "seen")
        wanted = F.broadcast(seen) if seen.count() <= BROADCAST_ROWS else seen
        texts = saved(rows.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).groupBy("class").agg(F.first("text").alias("text")), "texts")
        found = saved(verified(likely, texts, n, percent), "links")
        dropped(likely, seen, texts)
        return found

    def some(df: DataFrame) -> bool:
        return bool(df.limit(1).count())

    def parts_of(component: DataFrame) -> DataFrame:
        return component.withColumnRenamed("node", "class").join(classes.select("class", "node"), "class").select("node", F.xxhash64(F.lit(0), "component").alias("component"))

    def divided(component: DataFrame, members: DataFrame) -> DataFrame:
        """Members of the n-grams whose sets are in several components, with each n-gram's largest one and number of sets."""
        members = members.select("g", "node", "n", "at", "node_c").join(parts_of(component), "node", "left").withColumn("component", F.coalesce("component", F.xxhash64(F.lit(1), "node")))
        main = members.groupBy("g", "component").agg(F.count("*").alias("k")).groupBy("g").agg(F.max(F.struct("k", "component")).alias("m"), F.count("*").alias("parts"), F.sum("k").alias("sets")).filter("parts > 1")
        return saved(members.join(main.select("g", F.col("m.component").alias("main"), "sets"), "g"), "members")

    def merged(before: DataFrame, after: DataFrame, members: DataFrame) -> DataFrame:
        """Members by the components after more links: the few that changed are renamed, and no n-gram's sets meet again."""
        was = parts_of(before).withColumnRenamed("component", "was")
        names = parts_of(after).join(was, "node", "left").withColumn("was", F.coalesce("was", F.xxhash64(F.lit(1), "node")))
        names = saved(names.filter("was <> component").groupBy("was").agg(F.min("component").alias("now")), "names")
        new = lambda c: names.select(F.col("was").alias(c), F.col("now").alias(f"{c}_now"))
        out = members.join(new("component"), "component", "left").join(new("main"), "main", "left")
        out = saved(out.select("g", "node", "n", "at", "node_c", F.coalesce("component_now", "component").alias("component"), F.coalesce("main_now", "main").alias("main"), "sets"), "members")
        dropped(names)
        return out

    links = linked(shared.filter("star").select(F.col("node_c").alias("x"), F.col("node").alias("y")))
    component = components(links)

    # more centres, from the largest component of an n-gram, as long as that joins a good part of what is outside
    members = divided(component, shared.filter("many"))
    dropped(shared)
    for turn in range(TURNS):
        main = members.filter("component = main").groupBy("g").agg(F.count("*").alias("k"), *[F.min_by(F.struct("node", "n", "at"), F.xxhash64("node", F.lit(turn), F.lit(k))).alias(f"c{k}") for k in range(CENTRES)])
        centres = main.filter(F.col("k") >= CENTRES).select("g", F.explode(F.array_distinct(F.array(*[f"c{k}" for k in range(CENTRES)]))).alias("c"))
        centres = centres.select("g", F.col("c.node").alias("x"), F.col("c.n").alias("n_x"), F.col("c.at").alias("at_x"))
        outside = members.filter("component <> main").select("g", F.col("node").alias("y"), "n", "at", "node_c")
        found = linked(outside.join(centres, "g").filter((F.col("x") != F.col("node_c")) & possible("n_x", "at_x", "n", "at")).select("x", "y"))
        gained = found.count()
        if not gained:
            break
        links, before, more = saved(links.union(found), "links"), members, component
        component = components(links)
        apart, members = outside.select("y").distinct().count(), merged(more, component, before)
        dropped(before, more)
        if gained * 20 < apart:
            break

    # what is still outside is paired with the sets of other components, each pair by the first n-gram that both heads show
    first = W.partitionBy("node").orderBy("at", "g")
    heads = members.select("node", "at", "g").withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= HEAD)
    heads = heads.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "g"))), lambda s: s["g"]).alias("head"))
    known = classes.select("node", *BITS)
    before, members = members, saved(members.join(known.join(heads, "node"), "node"), "members")
    dropped(before)
    parts = F.ceil(F.col("sets") / GROUP).cast("int")
    fewer = members.filter("component <> main").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    fewer = fewer.select("g", "_salt", F.col("node").alias("x"), F.col("n").alias("n_x"), F.col("at").alias("at_x"), F.col("component").alias("c_x"), F.col("node_c").alias("centre_x"), F.col("head").alias("head_x"), *[F.col(k).alias(f"{k}_x") for k in BITS])
    others = members.select("g", F.pmod(F.xxhash64("node"), parts).cast("int").alias("_salt"), F.col("node").alias("y"), "n", "at", "component", "node_c", "main", "head", *BITS)
    new = (F.col("c_x") != F.col("component")) & (F.col("y") != F.col("centre_x")) & (F.col("x") != F.col("node_c")) & ((F.col("component") == F.col("main")) | (F.col("x") < F.col("y")))
    once = F.coalesce(F.get(F.array_intersect("head_x", "head"), F.lit(0)) == F.col("g"), F.lit(True))
    rest = fewer.join(others, ["g", "_salt"]).filter(new & possible("n_x", "at_x", "n", "at") & near("n_x", [f"{k}_x" for k in BITS], "n", list(BITS)) & once)
    found = linked(rest.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")))
    dropped(members)
    if some(found):
        component = components(links.union(found))

    of = component.withColumnRenamed("node", "class")
    known = classes.join(of, "class", "left").select("n", "node", "check", "class_id", F.coalesce("component", "class").alias("component"))
    least = known.groupBy("component").agg(F.min("class_id").alias("component_id"))
    out = all_rows.select("id", "k1", "k2", "n", "node", "check").join(known.join(least, "component"), ["n", "node", "check"], "left")
    return out.select("id", "k1", "k2", "n", F.coalesce("class_id", "id").alias("class_id"), "component", F.coalesce("component_id", "id").alias("component_id"))


def near_duplicates(
    docs: DataFrame,
    n: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    heavy_from: int = 8,
    heavy: int = 1 << 19,
) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, class_id (documents of equal sets), component_id."""
    out = grouped_rows(docs, n, percent, id_col, text_col, heavy_from, heavy)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "component_id")


def without_near_copies(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", heavy_from: int = 8, heavy: int = 1 << 19) -> DataFrame:
    """The rows of ``docs`` of which one stays in each group of linked documents: that with the smallest identifier.

    Decided row by row: of rows with equal (or null) identifiers and different
    texts only those go that have a link; of rows equal in identifier and text
    one stays; null identifiers come last. Rows without n-grams all stay.
    """
    found = saved(grouped_rows(docs, n, percent, id_col, text_col, heavy_from, heavy).filter("n > 0").select("id", "k1", "k2", "component"), "found")
    best = found.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("b")).select("b.k1", "b.k2", F.lit(True).alias("best"))
    keys = found.groupBy("k1", "k2").agg(F.count("*").alias("times")).join(best, ["k1", "k2"], "left")
    keys = saved(keys.select("k1", "k2", F.col("best").isNull().alias("gone"), (F.col("times") > 1).alias("again")).filter("gone OR again"), "keys")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *row_keys(id_col, whole_text(text_col)))
    single = rows.join(keys.select("k1", "k2"), ["k1", "k2"], "left_anti")
    repeated = rows.join(keys.filter("NOT gone").select("k1", "k2"), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    return single.unionByName(repeated).select("_doc.*")


def op2_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=90)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS gram
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n, md5(string_agg(gram, chr(10) ORDER BY gram)) AS sig FROM g GROUP BY doc_id
), i AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.d
), m AS (
  SELECT d, min(c) AS component_id FROM r GROUP BY d
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, CASE WHEN n.sig IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY n.sig) END AS class_id, m.component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.d = d.doc_id
"""
