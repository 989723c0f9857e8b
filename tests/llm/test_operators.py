"""Each operator against a plain version or an invariant, with nulls, empty and long texts, ties, repeats, empty tables and extra columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyfold.llm import blocks, bpe, components, content_sort, feistel, fm, ftrl, jaccard, packing, pii, urls, words
from keyfold.llm.shared import crc_mod

TEXTS = [None, "", " ", "same", "same", "same", "a b c d", "A  b\tc d", "word " * 3000, "x" * 50_000, "é ü\u3000日本 🙂", "tail \n", "don't  stop", "<|endoftext|> a"]
DOCS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "same"), (None, "same"), (None, None)]
CLASH = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    """Rows with repeats and null identifiers, and columns whose names operators use inside."""
    df = spark.createDataFrame(DOCS, CLASH)
    for name in ("score", "ids", "n", "kind", "start", "_id", "_text", "_row", "label", "row_no", "size", "group"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], CLASH)


def whole(t):
    return t or ""


# exact dedup


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_content_sort(docs, keep, partitions):
    got = content_sort.content_sort(docs, keep=keep, partitions=partitions, carry=("text", "kind")).collect()
    groups = defaultdict(list)
    for i, t in DOCS:
        groups[whole(t)].append(i)
    assert Counter((r["doc_id"], whole(r["text"])) for r in got) == Counter((i, whole(t)) for i, t in DOCS)
    for r in got:
        ids = [i for i in groups[whole(r["text"])] if i is not None]
        assert r["keep_id"] == ((min if keep == "smallest" else max)(ids) if ids else None)
        assert r["group_size"] == len(groups[whole(r["text"])])
        assert r["text_sha256"] == hashlib.sha256(whole(r["text"]).encode()).hexdigest()
    assert Counter(whole(r["text"]) for r in got if r["kept"]) == Counter(dict.fromkeys(groups, 1))


def test_content_sort_of_one_hot_text(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise("hot").alias("text"))
    got = content_sort.content_sort(df, partitions=9)
    assert got.filter("kept").count() == 501 and got.filter("group_size = 4500 AND keep_id = 1").count() == 4500


@pytest.mark.parametrize("kept_only", [False, True])
@pytest.mark.parametrize("batch", [7, 1000])
def test_content_sort_hands_hot_runs_on_in_pieces(spark, monkeypatch, kept_only, batch):
    """Pieces of at most 50 rows, whatever the run and the batches."""
    monkeypatch.setattr(content_sort, "PIECE", 50)
    monkeypatch.setattr(content_sort, "PIECE_BYTES", 2000)
    start = "the same beginning of many texts, longer than what splitters see of them: "
    rows = [(i, None if i % 400 == 3 else ["hot " + "x" * 90, start + "one", start + str(i % 40), f"single {i}"][i % 4 if i % 8 > 3 else 0]) for i in range(1600)]
    df = spark.createDataFrame(rows, CLASH)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        got = content_sort.content_sort(df, partitions=3, carry=("text", "keep_id") if "keep_id" in df.columns else ("text",), kept_only=kept_only).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    groups = defaultdict(list)
    for i, t in rows:
        groups[whole(t)].append(i)
    assert sorted(r["doc_id"] for r in got if r["kept"]) == sorted(min(g) for g in groups.values())
    assert len(got) == (len(groups) if kept_only else len(rows))
    texts = dict(rows)
    for r in got:
        assert r["text"] == texts[r["doc_id"]] and r["group_size"] == len(groups[whole(r["text"])]) and r["keep_id"] == min(groups[whole(r["text"])])


def test_runs_of_a_task_stay_small(monkeypatch):
    """A run of very many rows goes out in pieces: no batch follows its length."""
    import pyarrow as pa

    monkeypatch.setattr(content_sort, "PIECE", 100)
    monkeypatch.setattr(content_sort, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    names = ["_id", "_digest", "keep_id", "_part", "_run", "group_size", "_head", "_summary", "_body"]
    pass_ = content_sort._runs(["_id", "_digest"], names, 48, True, False)
    text = "t" * 1000
    batches = (pa.RecordBatch.from_pydict({"_id": pa.array(range(k, k + 60), pa.int64()), "_text": [text] * 60, "_digest": ["d"] * 60}) for k in range(0, 6000, 60))
    rows = total = 0
    for b in pass_(batches):
        assert len(b) <= 160
        rows += sum(x is None for x in b.column("_summary").to_pylist())
        total += sum(n for n, x in zip(b.column("group_size").to_pylist(), b.column("_summary").to_pylist()) if x is not None)
    assert rows == 6000 and total == 6000


def test_content_sort_carries_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a", "x", 1), (2, "a", "y", 2), (3, None, "z", 3)], "doc_id long, text string, keep_id string, _body int")
    got = content_sort.content_sort(df, carry=("text", "keep_id", "_body", "doc_id"))
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "text", "carried_keep_id", "_body"]
    assert sorted((r["doc_id"], r["keep_id"], r["kept"], r["text"], r["carried_keep_id"], r["_body"]) for r in got.collect()) == [(1, 1, True, "a", "x", 1), (2, 1, False, "a", "y", 2), (3, 3, True, None, "z", 3)]


def test_content_sort_normalises(spark):
    df = spark.createDataFrame([(1, "A"), (2, "a ")], CLASH)
    got = content_sort.content_sort(df, normalise=lambda t: F.lower(F.trim(t))).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in got} == {(1, 1, True), (2, 1, False)}


# sharding


@given(st.integers(1, 3000), st.integers(0, 2**32))
@settings(max_examples=30, deadline=None)
def test_feistel_is_a_permutation(n, seed):
    p = feistel.permute(np.arange(n), n, seed)
    assert sorted(p.tolist()) == list(range(n))
    assert (feistel.permute(p, n, seed, back=True) == np.arange(n)).all()
    s, t = feistel.place(np.arange(n), n, 7, seed)
    assert (feistel.row_at(s, t, n, 7, seed) == np.arange(n)).all()


def test_shards(docs, spark):
    got = feistel.shard(docs, shards=4).collect()
    assert len(got) == len(DOCS)
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    want = Counter((i, len(whole(t).encode()) + 16, zlib.crc32(whole(t).encode())) for i, t in DOCS)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    one = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    a, b = ({r["doc_id"]: (r["shard"], r["slot"]) for r in feistel.shard(x).collect()} for x in (one, one.repartition(11)))
    assert a == b
    first = [a[i][0] for i in range(40)]
    assert len(set(first)) > 15  # neighbours are spread


def test_shards_against_a_plain_feistel_network(spark):
    """Whole numbers only, one at a time: six rounds, walking on while outside."""
    n, shards, seed, word = 137, 5, 20_240_101, 2**64 - 1

    def mix(x, key):
        z = (x + key) & word
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & word
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & word
        return z ^ (z >> 31)

    keys = [(seed * 0xD1342543DE82EF95 + (r + 1) * 0x9E3779B97F4A7C15) % 2**64 for r in range(6)]
    half = ((n - 1).bit_length() + 1) // 2

    def step(x):
        left, right = x >> half, x & ((1 << half) - 1)
        for key in keys:
            left, right = right, left ^ (mix(right, key) & ((1 << half) - 1))
        return left << half | right

    rows = [(i * 3, f"text {i % 50}") for i in range(n)]
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in feistel.shard(spark.createDataFrame(rows, CLASH).repartition(5), shards=shards, seed=seed).collect()}
    for k, (i, _) in enumerate(rows):
        p = step(k)
        while p >= n:
            p = step(p)
        assert got[i] == (p % shards, p // shards)


# tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet=" \n\t.,;:!?'ab\u00e9\u00a0\u0085\u3000<|>endoftx", max_size=40)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_have_the_ids_of_the_whole_text(name, texts):
    import pyarrow as pa

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    own = words.encoder(bpe.vocabulary(name), 1000)
    parts, starts = words.split(pa.array(texts, pa.string()))
    got = [np.frombuffer(x, "<u4").tolist() for x in words.grouped(own.encode(parts), starts).to_pylist()]
    assert got == [e.ids for e in own.library.encode_batch(texts, add_special_tokens=False)]
    if "byte" in name:
        pieces = bpe.byte_pieces(bpe.vocabulary(name))
        back = bpe.texts_of(words.grouped(own.encode(parts), starts), pieces).to_pylist()
        assert back == [own.library.decode(i, skip_special_tokens=False) for i in got]


def test_encode_and_decode(docs):
    path = bpe.vocabulary("byte_bpe_50k.json")
    library = words.Encoder(path).library
    encoded = bpe.encode(docs, path, table_words=3)
    got = bpe.decode(encoded, path).collect()
    want = Counter((i, np.array(library.encode(whole(t), add_special_tokens=False).ids, "<u4").tobytes(), whole(t)) for i, t in DOCS)
    assert Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in got) == want


def test_plan_is_whole_and_tight():
    rng = np.random.default_rng(3)
    for _ in range(20):
        capacity = int(rng.integers(1, 60))
        counts = Counter(rng.integers(1, capacity + 1, 200).tolist())
        made = packing.plan(counts, capacity)
        used = Counter()
        for pattern, times in made:
            assert sum(pattern) <= capacity and times > 0
            for n in pattern:
                used[n] += times
        assert used == counts
    # 6 + 3 leaves a gap of 1 in 10; 2 + 2 in the place of 3 fills it
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10)[0] == ([6, 2, 2], 1)


def test_pack(docs):
    path = bpe.vocabulary("word_bpe_49k.json")
    library = words.Encoder(path).library
    got = packing.pack(packing.token_ids(docs, path), capacity=64).collect()
    want = Counter()
    for i, t in DOCS:
        ids = [*library.encode(whole(t), add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            want[i, k // 64, k, np.array(ids[k : k + 64], "<u4").tobytes()] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], bytes(r["ids"])) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64


# near duplicates


def plain_sets(rows, n):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), whole(t)))
        out.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    return out


def plain_components(sets, percent):
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_near_duplicates(spark, n, percent):
    rng = np.random.default_rng(n)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(["A b", "a  B", "a", "", None, " \n", "one two three", "one two three"])]
    for base in range(12):
        text = rng.choice(vocabulary, int(rng.integers(6, 90))).tolist()
        for _ in range(8):
            copy = list(text)
            for _ in range(int(rng.integers(0, 3))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(vocabulary))
            rows.append((len(rows), " ".join(["common line of all texts"] * (base % 2) + copy)))
    df = spark.createDataFrame(rows, CLASH).withColumn("node", F.lit("clash")).withColumn("n", F.lit(1))
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(df, n=n, percent=percent, heavy_from=3).collect()}
    sets = plain_sets(rows, n)
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets}
    assert {i: r["component_id"] for i, r in got.items()} == plain_components(sets, percent)


def test_runs_of_postings():
    """Centres, stars and members of runs, whatever the batches."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    rows = sorted({(int(g), int(s), int(v) % 3, int(v)) for g, s, v in zip(rng.integers(0, 30, 300), rng.integers(0, 2, 300), rng.integers(0, 40, 300))})
    rows = [r for r in rows if r[1] == 0 or r[0] < 5]
    rows += [r for r in rows if r[3] % 7 == 0]  # sets that come twice
    rows.sort()
    table = [(g, v, (20 << 32) | (v % 3), (o << 16) | s) for g, s, o, v in rows]
    runs = defaultdict(dict)
    for g, v, at, own in table:
        runs[g, own & 0xFFFF].setdefault(v, at)
    want = set()
    for (g, salt), sets in runs.items():
        many = len(sets) > 2 or salt > 0
        c = next(iter(sets))
        want |= {(g, v, v != c, many, c) for v in sets if many or v != c}
    for step in (1, 2, 3, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*table[k : k + step])], names=["g", "node", "n_at", "own"]) for k in range(0, len(table), step)]
        got = [r for b in jaccard.met(iter(batches), 50) for r in b.to_pylist()]
        assert {(r["g"], r["node"], r["star"], r["many"], r["node_c"]) for r in got} == want, step


def test_runs_without_possible_links_are_left_out():
    """Of a small run only the sets stay that the filters leave a link with another one than the centre; of dealt and cut runs all."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    drawn = zip(rng.integers(0, 60, 900).tolist(), rng.integers(1, 60, 900).tolist(), range(900))
    rows = sorted((g, int(g < 5), v, n, v % min(n, 9)) for g, n, v in drawn)
    table = [(g, v, (n << 32) | at, salt) for g, salt, v, n, at in rows]

    def possible(x, y):
        (n, i), (m, j) = x, y
        need = -(-90 * (n + m) // 190)
        return 100 * min(n, m) >= 90 * max(n, m) and min(i, j) + 1 + min(n - i - 1, m - j - 1) >= need

    runs = defaultdict(dict)
    for g, _, v, n, at in rows:
        runs[g][v] = (n, at)
    hopeful = {(g, v) for g, sets in runs.items() for v in list(sets)[1:] if any(w != v and possible(sets[v], sets[w]) for w in list(sets)[1:])}
    for step in (7, 100, 10_000):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*table[k : k + step])], names=["g", "node", "n_at", "own"]) for k in range(0, len(table), step)]
        all_rows = [r for b in jaccard.met(iter(batches), 90) for r in b.to_pylist()]
        got = [r for b in jaccard.narrowed(jaccard.met(iter(batches), 90), 90) for r in b.to_pylist()]
        assert [(r["g"], r["node"]) for r in got if r["star"]] == [(r["g"], r["node"]) for r in all_rows if r["star"]]
        left = {(r["g"], r["node"]) for r in got if r["many"]}
        assert hopeful <= left <= {(r["g"], r["node"]) for r in all_rows if r["many"]}
        assert {(r["g"], r["node"]) for r in all_rows if r["g"] < 5} <= left
    whole = {g for g in runs if 5 <= g < max(runs)}
    assert {x for x in left if x[0] in whole} == {x for x in hopeful if x[0] in whole}


@pytest.mark.parametrize("many", [12, 400])
def test_near_duplicates_with_one_common_ngram(spark, many, monkeypatch):
    """Texts around one passage that do not link, and pairs among them that do, with salts, groups and turns at work."""
    monkeypatch.setattr(jaccard, "RUN", 50)
    monkeypatch.setattr(jaccard, "GROUP", 20)
    rng = np.random.default_rng(many)
    passage = [f"p{i}" for i in range(24)]
    rows = []
    for i in range(many):
        own = [f"o{i}x{k}" for k in range(int(rng.integers(1, 9)))]
        rows.append((len(rows), " ".join([*own[:3], *passage[: int(rng.integers(14, 25))], *own[3:]])))
        if i % 5 == 0:
            rows.append((len(rows), rows[-1][1] + " tail"))
    df = spark.createDataFrame(rows, CLASH).repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(df, n=2, percent=80, heavy_from=3).collect()}
    assert got == plain_components(plain_sets(rows, 2), 80)


def test_near_copies_go_by_row(spark):
    """Identifiers that repeat or are null neither save a near copy nor cost an unrelated text."""
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, "a"), (1, long + " x", "b"), (1, "quite another text of a few words here", "c"), (None, long + " y", "d"), (None, "a null identifier and a text alone", "e"), (2, long, "f"), (3, "", "g"), (3, "", "h"), (4, None, "i"), (5, "word " * 40_000, "j"), (6, "word " * 40_001, "k"), (7, "rows that are the same", "l"), (7, "rows that are the same", "l")]
    df = spark.createDataFrame([(i, t, x, "clash", 1) for i, t, x in rows], "doc_id long, text string, lang string, k1 string, n int").repartition(3)
    got = jaccard.without_near_copies(df)
    assert got.columns == df.columns
    kept = sorted(r["lang"] for r in got.collect())
    assert kept in (sorted(first + "ceghijl") for first in "ab")


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in components.components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_personal_data(spark):
    rng = np.random.default_rng(1)
    parts = ["a@b.c", "x_y@d-e.f.g", "@", "_", "+", "1.2.3.4", "001.255.0.9", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 555-1234", "+123", " ", "é", "🙂", ".", "-", "9", "ab", "call", "\n"]
    texts = ["".join(rng.choice(parts, int(rng.integers(1, 14)))) for _ in range(300)] + ["a" * 60_000, "1" * 60_000, "1." * 5000, "+1 " * 400 + "2", None, ""]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, CLASH).withColumn("kind", F.lit("clash")).withColumn("start", F.lit(1))
    found = pii.spans_by_row(pii.find(df)).select("doc_id", *[f"n_{k}" for k in pii.KINDS], pii._joined("base").alias("base"), pii._joined("spans").alias("spans")).collect()
    assert len(found) == len(rows)
    for r in found:
        want = plain_spans(whole(texts[r["doc_id"]]))
        assert r["base"] == want, texts[r["doc_id"]]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [len(re.findall(k + ":", want)) for k in pii.KINDS]
        assert r["spans"].startswith(want)
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df.select("doc_id", "text")).collect()}
    assert clean[len(texts) - 2] is None and clean[len(texts) - 1] == ""
    assert all(not re.search(PLAIN["email"], t) for t in clean.values() if t)


def test_redaction_when_later_scans_are_split_otherwise(spark):
    rows = [(i, f"mail u{i}@site.org now" if i % 3 == 0 else f"clean {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    names = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    clean = pii.redact(df)
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        got = {r["doc_id"]: r["text"] for r in clean.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert got == {i: "mail [EMAIL] now" if i % 3 == 0 else t for i, t in rows}


def planted(n=240):
    """Texts with spans that should be added, and with others that look alike and should not."""
    rng = np.random.default_rng(8)
    digits = lambda k: "".join(map(str, rng.integers(0, 10, k)))

    def card(prefix, size, good):
        body = prefix + digits(size - len(prefix) - 1)
        right = next(c for c in "0123456789" if luhn(body + c))
        return body + (right if good else str((int(right) + 1 + int(rng.integers(9))) % 10))

    words = "the of river stone walk green under paper light many".split()
    rows = []
    for i in range(n):
        area, office, line = f"{rng.integers(2, 10)}{digits(2)}", f"{rng.integers(2, 10)}{digits(2)}", digits(4)
        good, bad = [
            (f"call me on {area}-{office}-{line}", f"invoice {digits(3)}.{digits(3)}-{digits(3)}"),
            (f"tel ({area}) {office}-{line}", f"lot {digits(5)}-{digits(4)}"),
            (f"write to ann{i} [at] mail{i % 9} [dot] org", f"look [at] them{i}"),
            (f"amex {card('37', 15, True)}", f"order {card('98', 15, False)}"),
            (f"two numbers {card('41', 16, True)} {card('98', 16, False)}", f"tracking {card('45', 16, False)}"),
            (f"api_key = '{rng.bytes(16).hex()}'", "password = changeme"),
            (f"secret: {rng.bytes(12).hex()}", "token: string"),
            (f"fax 0{rng.integers(1, 6)} {' '.join(digits(2) for _ in range(4))}", f"dated {rng.integers(1, 29):02d}-{rng.integers(1, 13):02d}-{rng.integers(1980, 2030)}"),
        ][i % 8]
        fill = lambda: " ".join(rng.choice(words, 6))
        rows.append((i, f"{fill()} {good} {fill()}", True))
        rows.append((n + i, f"{fill()} {bad} {fill()}", False))
    return rows


def test_personal_data_added_by_weak_supervision(spark):
    rows = planted()
    found = defaultdict(list)
    for r in pii.find(spark.createDataFrame([r[:2] for r in rows], CLASH)).filter("kind IS NOT NULL AND NOT base").collect():
        found[r["doc_id"]].append((r["kind"], r["start"], r["end"]))
    texts = {i: t for i, t, _ in rows}
    hits = sum(bool(found[i]) for i, _, good in rows if good)
    wrong = {texts[i]: found[i] for i, _, good in rows if not good and found[i]}
    total = sum(good for *_, good in rows)
    assert hits / total >= 0.9, (hits, total, [t for i, t, good in rows if good and not found[i]][:20])
    assert hits / max(1, hits + len(wrong)) >= 0.9, wrong
    for i, spans in found.items():
        for kind, a, b in spans:
            d = re.sub("[^0-9]", "", texts[i][a:b])
            assert kind != "card_like" or luhn(d)


def test_posteriors_follow_agreeing_labelers():
    counts = [((1, 1, 1, 0, 0), 50), ((1, -1, -1, 0, 0), 40), ((1, 0, 1, 1, 0), 10), ((-1, -1, 0, -1, -1), 30)]
    p = pii.em(counts)
    assert p[1, 1, 1, 0, 0] > 0.9 and p[1, 0, 1, 1, 0] > 0.9 and p[1, -1, -1, 0, 0] < 0.1 and p[-1, -1, 0, -1, -1] < 0.01


def test_redaction_keeps_other_columns(spark):
    df = spark.createDataFrame([(1, "a@b.c and token = 'abcdef0123456789abcdef'", "x", 5), (None, None, None, None), (1, "", "y", 6)], "doc_id long, text string, _cuts string, _row int").withColumn("_doc", F.lit(1)).withColumn("kind", F.lit("k"))
    got = pii.redact(df)
    assert got.columns == df.columns
    assert sorted((r["text"] or "", r["_cuts"] or "", r["_row"] or 0) for r in got.collect()) == [("", "", 0), ("", "y", 6), ("[EMAIL] and [SECRET_LIKE]", "x", 5)]


# classifiers


def quality_rows(n=400):
    rng = np.random.default_rng(2)
    vocabulary = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(n):
        w = rng.choice(vocabulary, int(rng.integers(20, 80))).tolist()
        good = i % 3 > 0
        rows.append((i, " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w[:5] * 6), len(w), int(good)))
    return rows


def test_quality_learns_and_keeps_its_promises(spark):
    rows = quality_rows()
    df = spark.createDataFrame([(i, t, n) for i, t, n, _ in rows] + [(1000, None, None), (1001, "", 0), (None, "w", 1)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows] + [(5, None), (None, 1)], "doc_id long, quality int")
    model = fm.train(df, labels, crc_mod("_id", 3) != 1, metadata=("n_chars",))
    got = {r["doc_id"]: r["score"] for r in fm.score(df, model, metadata=("n_chars",)).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= s <= 1 for s in got.values())
    held = [(got[i], q) for i, _, _, q in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(s >= 0.5) == q for s, q in held]) > 0.95
    # the sum-of-squares identity against the sum over pairs
    import pyarrow as pa

    r, f, x = fm.features(pa.array([rows[0][1]]), [pa.array([3])], model.word_bits)
    pairs = sum(float(model.vectors[f[i]] @ model.vectors[f[j]]) * x[i] * x[j] for i in range(len(f)) for j in range(i))
    z = model.bias + float((model.weights[f] * x).sum()) + pairs
    assert abs(model.score(r, f, x, 1)[0] - 1 / (1 + np.exp(-z))) < 1e-9


def test_classifiers_without_labels(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame([(1, "a"), (2, None)], CLASH)
    assert [r["score"] for r in fm.score(df, fm.train(df, labels, F.lit(True))).collect()] == [0.5, 0.5]
    model = ftrl.train(df, labels, F.lit(True))
    assert [r["score"] for r in ftrl.score(df, model).collect()] == [0.5, 0.5]
    assert ftrl.score(empty, model).count() == 0


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"word{i}" for i in range(300)]
    rows = []
    for i in range(600):
        w = rng.choice(vocabulary, int(rng.integers(10, 60))).tolist()
        if i % 5 == 0:
            w[int(rng.integers(len(w)))] = ["vile,", "Vileness", "vilest"][i % 3]
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    df = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None)], CLASH)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = ftrl.train(df, labels, crc_mod("_id", 4) != 2)
    assert len(model.buckets) < 2000
    got = {r["doc_id"]: r["score"] for r in ftrl.score(df, model).collect()}
    held = [(got[i] >= 0.3, bool(y)) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([a == b for a, b in held]) > 0.97 and len(got) == 601


def test_labelled_rows_are_bounded_and_always_the_same(spark):
    from keyfold.llm.features import collected, labelled

    rows = [(i % 10, f"text {i}") for i in range(500)] + [(100 + i, f"one {i}") for i in range(300)] + [(None, "x")]
    df = spark.createDataFrame(rows, "_id long, _text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(3, None), (4, 7), (None, 1)], "_id long, toxic int")
    got = [sorted(map(tuple, labelled(x, y, "toxic", F.lit(True), 50).collect())) for x, y in ((df, labels), (df.repartition(7), labels.repartition(5)))]
    assert got[0] == got[1] and 0 < len(got[0]) <= 50
    everything = labelled(df, labels, "toxic", F.lit(True), 10_000)
    assert everything.count() == 310  # one row of each of the repeated identifiers
    some = collected(everything, F.octet_length("_text"), 1600)
    assert 0 < sum(map(len, some.column("_text").to_pylist())) <= 1600 and some.column("_h").to_pylist() == sorted(some.column("_h").to_pylist())
    assert not len(collected(everything, F.lit(10_000), 1600))


def test_ftrl_against_a_plain_loop():
    """The update of each coordinate, as published, one number at a time."""
    from math import exp, log, sqrt

    rng = np.random.default_rng(12)
    rows = [(np.unique(rng.integers(0, 32, 6)).astype("<i4"), int(rng.integers(2))) for _ in range(80)]
    rows = list({(f.tobytes(), y): (f, y) for f, y in rows}.values())
    alpha, beta, l1, l2, epochs = 0.3, 1.0, 0.5, 0.2, 3
    model = ftrl.fit(rows, 5, alpha, beta, l1, l2, epochs, least_rows=1, seed=3)
    z, n, zb, nb = [0.0] * 32, [0.0] * 32, 0.0, 0.0
    share = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1)
    bias = start = log(share / (1 - share))
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + sqrt(n[i])) / alpha + l2)
    order = np.random.default_rng(3)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            f, y = rows[k]
            w = {int(i): weight(i) for i in f}
            g = 1 / (1 + exp(-(bias + sum(w.values())))) - y
            for i in w:
                s = (sqrt(n[i] + g * g) - sqrt(n[i])) / alpha
                z[i] += g - s * w[i]
                n[i] += g * g
            s = (sqrt(nb + g * g) - sqrt(nb)) / alpha
            zb, nb = zb + g - s * (bias - start), nb + g * g
            bias = start - zb / ((beta + sqrt(nb)) / alpha)
    dense = model.dense()
    assert np.allclose(dense, [weight(i) for i in range(32)], atol=1e-9) and abs(model.bias - bias) < 1e-9
    assert 0 < (dense == 0).sum() < 32  # sparse, not empty


def test_classifiers_meet_clashing_names(spark, empty):
    names = ("_text_", "_text", "doc", "m0", "_meta_0", "id", "f", "label", "_id", "_h", "score")
    rows = quality_rows(120)
    df = spark.createDataFrame([(i, t, n) for i, t, n, _ in rows] + [(None, "z" * 3_000_000, None), (1, rows[1][1], 3)], "doc_id long, text string, n_chars long")
    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    labels = spark.createDataFrame([(i, q, 1 - q) for i, _, _, q in rows], "doc_id long, quality int, toxic int")
    model = fm.train(df, labels, F.lit(True), metadata=("n_chars",))
    got = fm.score(df, model, metadata=("n_chars",))
    assert sorted(got.columns) == sorted(df.columns) and got.filter("score BETWEEN 0 AND 1 AND doc = 'clash'").count() == len(rows) + 2
    toxic = ftrl.score(df, ftrl.train(df, labels, F.lit(True)))
    assert toxic.columns == ["doc_id", "score"] and toxic.filter("score BETWEEN 0 AND 1").count() == len(rows) + 2
    assert fm.score(empty, fm.train(empty, labels, F.lit(True))).count() == 0


# URLs


def test_urls(spark):
    cases = {
        "http://A.example.com/en/712?x": ("a.example.com", "/en/712", "example.com/en/7", "allow"),
        "https://b.COM/en/1#t": ("b.com", "/en/1", "com/en/", "block"),
        "x://net/de/8": ("net", "/de/8", "net/de/", "allow"),
        "x://www.example.net/de/80": ("www.example.net", "/de/80", "example.net/de/8", "block"),
        "x://notexample.com/en": ("notexample.com", "/en", None, "allow"),
        "x://org?/es/": ("org", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "://": ("", "", None, "allow"),
        "x://É.org/es/a\nb": ("É.org", "/es/a\nb", "org/es/", "block"),
        None: ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(cases)] + [(0, next(iter(cases)), "h")], "page_id long, url string, host string")
    none = spark.createDataFrame([], "number long, verdict string")
    got = urls.judge(df, none).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == list(cases.values())[r["page_id"]]


def test_urls_mine_rules(spark):
    rows = [(i, f"http://{'spam-farm' if i % 4 == 0 else 'good'}.site.io/{'win' if i % 2 else 'news'}/{i}") for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, "block" if i % 4 == 0 else "allow") for i in range(0, 300)], "number long, verdict string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df, labels).collect()}
    assert all(got[i] == ("block" if i % 4 == 0 else "allow") for i in range(400))


@pytest.mark.parametrize("block", [0.2, 0.8, 1.0])
def test_urls_keep_rules_of_a_common_verdict(spark, block):
    hosts = {"spam": 200, "good": 0} if block == 1 else {"spam": int(200 * block), "good": 200 - int(200 * block)}
    names = [h for h, n in hosts.items() for _ in range(n)]
    rows = [(i, f"http://{h}.site.io/{'win' if i % 2 else 'news'}/{i}") for i, h in enumerate(names)]
    df = spark.createDataFrame(rows + [(900, "http://spam.site.io/win/none"), (901, "http://good.site.io/win/none")], "page_id long, url string")
    labels = spark.createDataFrame([(i, "block" if h == "spam" else "allow") for i, h in enumerate(names)], "number long, verdict string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df, labels).collect()}
    assert got[900] == "block" and all(got[i] == ("block" if h == "spam" else "allow") for i, h in enumerate(names))
    assert block == 1 or got[901] == "allow"


def test_urls_confident_allow_rule_beats_a_weak_block_rule(spark):
    """Of 100 URLs with "mixed" 60 are block, none of the 10 that also have "safe"; 80 % of all are allow."""
    path = lambda i: "mixed/safe" if i < 10 else "mixed" if i < 100 else "plain"
    df = spark.createDataFrame([(i, f"http://h.io/{path(i)}/{i}") for i in range(300)], "page_id long, url string")
    labels = spark.createDataFrame([(i, "block" if 40 <= i < 100 else "allow") for i in range(300)], "number long, verdict string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df, labels).collect()}
    assert all(got[i] == "allow" for i in range(10)) and all(got[i] == "block" for i in range(40, 100))


@pytest.mark.parametrize("place", ["path word", "host label", "key", "long word", "long key"])
def test_urls_mine_all_of_a_url(spark, place):
    def url(spam, i):
        word = "casino" if spam else "garden"
        deep = "/".join(f"part{c}" for c in "abcdefghijklmnopqrstuvwxyz")
        return {
            "path word": f"http://h.io/1a/2b/3c/4d/{deep}/{word}/{i}",
            "host label": f"http://a.b.c.d.e.f.{word}.h.site.io/{i}",
            "key": f"http://h.io/{i}?" + "&".join(f"k{c}=1" for c in "abcdefghijkl") + f"&{word}=1",
            "long word": f"http://h.io/{'x' * 70}{word}/{i}",
            "long key": f"http://h.io/{i}?{'x' * 70}{word}=1",
        }[place]

    df = spark.createDataFrame([(i, url(i % 4 == 0, i)) for i in range(240)], "page_id long, url string")
    labels = spark.createDataFrame([(i, "block" if i % 4 == 0 else "allow") for i in range(5, 200)], "number long, verdict string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df, labels).collect()}
    assert all(got[i] == ("block" if i % 4 == 0 else "allow") for i in range(240))


def test_urls_any_token_of_an_item_matches(spark):
    """ "bad" and "worse" occur together in all labelled URLs, alone in others."""
    rows = [(i, f"http://h.io/{'bad/worse' if i % 4 == 0 else 'fine'}/{i}") for i in range(100)] + [(200, "http://h.io/bad"), (201, "http://h.io/worse"), (202, "http://h.io/other")]
    labels = spark.createDataFrame([(i, "block" if i % 4 == 0 else "allow") for i in range(100)], "number long, verdict string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), labels).collect()}
    assert [got[i] for i in (200, 201, 202)] == ["block", "block", "allow"]


def test_urls_no_rules_from_labels_without_meaning(spark):
    """Labels that do not depend on the URL leave no rule that blocks."""
    rng = np.random.default_rng(6)
    words = [f"w{c}{d}" for c in "abcdefghij" for d in "klmnop"]
    rows = [(i, f"http://{rng.choice(words)}.{rng.choice(words)}.io/{rng.choice(words)}/{rng.choice(words)}/{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, "block" if rng.random() < 0.25 else "allow") for i in range(900)], "number long, verdict string")
    assert urls.judge(df, labels).filter("verdict = 'block'").count() == 0


def test_urls_rules_and_matches_against_brute_force(spark):
    from itertools import combinations
    from math import sqrt

    rng = np.random.default_rng(13)
    hosts, paths = ["good", "farm", "mixed", "late"], ["news", "win", "shop", "blog"]
    rows, verdicts = [], []
    for i in range(700):
        h, p, q = rng.choice(hosts), rng.choice(paths), rng.choice(paths)
        rows.append((i, f"http://{h}.io/{p}/{q}/{i}"))
        verdicts.append("block" if rng.random() < (0.95 if h == "farm" and "win" in (p, q) else 0.7 if h == "farm" else 0.1) else "allow")
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df, spark.createDataFrame(list(enumerate(verdicts))[:600], "number long, verdict string")).collect()}
    sets = []
    for _, u in rows:
        h, *w = u[7:].split("/")[:-1]
        sets.append(frozenset({"scheme:http", f"domain:{h}", *[f"host:{x}" for x in h.split(".")], *[f"path:{x}" for x in w]}))
    uses = defaultdict(set)
    for i in range(600):
        for t in sets[i]:
            uses[t].add(i)
    least = max(10, -(-600 * 2 // 1000))
    item = {}
    for t, ids in uses.items():
        if len(ids) >= least:
            item[t] = min(x for x in uses if uses[x] == ids)
    has = [frozenset(item[t] for t in s if t in item) for s in sets]
    share = {v: verdicts[:600].count(v) / 600 for v in ("allow", "block")}
    where = {x: {i for i in range(600) if x in has[i]} for x in set(item.values())}
    rules = {}
    for k in range(1, 6):
        for xs in combinations(sorted(where), k):
            ids = set.intersection(*[where[x] for x in xs])
            for v in share:
                both = sum(verdicts[i] == v for i in ids)
                if both < least:
                    continue
                c, n = both / len(ids), len(ids)
                low = lambda z: (c + z * z / (2 * n) - z * sqrt((c * (1 - c) + z * z / (4 * n)) / n)) / (1 + z * z / n)  # noqa: B023, E731
                sure = low(1.96) >= 0.6 if v == "allow" else low(3.29) > min(share[v], 0.9)
                if c >= 0.6 and (1 - c) * 1.5 <= 1 - share[v] and sure:
                    rules[xs, v] = (c, both / 600)
    part = lambda xs, x: tuple(sorted(set(xs) - {x}))
    rules = {(xs, v): r for (xs, v), r in rules.items() if not any(rules.get((part(xs, x), v), (-1,))[0] >= r[0] for x in xs)}
    assert any(v == "block" for _, v in rules)
    for i, _ in rows:
        met = [(c, s, -len(xs), v) for (xs, v), (c, s) in rules.items() if has[i].issuperset(xs)]
        assert got[i] == (max(met)[3] if met else "allow"), rows[i]
    held = [(got[i], verdicts[i]) for i in range(600, 700) if got[i] == "block"]
    assert held and np.mean([a == b for a, b in held]) > 0.6


def test_urls_very_long_and_clashing_names(spark):
    long = "http://a.example.org/es/" + "x/" * 200_000 + "?" + "&".join(f"k{i}=1" for i in range(5000))
    df = spark.createDataFrame([(1, long), (1, long), (None, None)], "page_id long, url string")
    for name in ("host", "path", "tokens", "_row", "_url", "_rest", "mined", "item", "verdict", "number"):
        df = df.withColumn(name, F.lit("clash"))
    got = urls.judge(df, spark.createDataFrame([(1, "block")], "number long, verdict string")).collect()
    assert sorted((r["page_id"] or 0, r["rule"] or "", r["verdict"], len(r["path"])) for r in got) == [(0, "", "allow", 0), (1, "org/es/", "block", 400_004), (1, "org/es/", "block", 400_004)]


# search


def plain_top(v, k=20, mod=20):
    whole = lambda x: [int(np.floor(64 * float(np.float32(c)))) for c in x]
    ok = [(i, whole(x)) for i, x in v if x is not None and None not in x and np.isfinite(np.array(x, dtype=np.float32)).all()]
    limit = 2**63 - 1
    want = defaultdict(list)
    for a, (i, x) in enumerate(ok):
        if i is not None and i % mod == 0:
            scores = [(max(-limit, min(limit, sum(p * q for p, q in zip(x, y)))), j) for b, (j, y) in enumerate(ok) if a != b and len(x) == len(y)]
            best = sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1]))[:k]
            want[i] += [(r, j, s) for r, (s, j) in enumerate(best, 1)]
    return {i: sorted(x, key=str) for i, x in want.items() if x}


@pytest.mark.parametrize(("block", "chunk", "per_task"), [(4, 3, 2), (64, 1, 100), (8, 2, 7)])
def test_top_k(spark, block, chunk, per_task):
    rng = np.random.default_rng(9)
    v = [(i, rng.normal(size=5).round(2).tolist()) for i in range(150)]
    v += [(200 + i, [0.5, 0.5, 0.5, 0.5, 0.5]) for i in range(30)]
    v += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0]), (302, [float("nan")] * 5), (303, [float("inf")] * 5), (320, [1.0, 2.0]), (340, []), (20, [1.0] * 5), (None, [2.0] * 5)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).withColumn("chunk", F.lit("clash"))
    got = defaultdict(list)
    for r in blocks.top_k(df, k=20, block=block, chunk=chunk, chunks=7, sample=40, per_task=per_task).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert {i: sorted(x, key=str) for i, x in got.items()} == plain_top(v)


def test_top_k_of_very_large_numbers(spark):
    """Products beyond 2**52 are exact, and those beyond 64 bits are the largest or smallest long."""
    rng = np.random.default_rng(10)
    v = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-1, 9)).tolist()) for i in range(60)]
    v += [(100 + i, (rng.normal(size=4) * 10.0 ** (20 + i)).tolist()) for i in range(10)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in blocks.top_k(df, k=65, block=8, chunk=2, chunks=3, sample=16).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert {i: sorted(x, key=str) for i, x in got.items()} == plain_top(v, k=65)


# empty tables


def test_empty_tables(spark, empty):
    path, wpath = bpe.vocabulary("byte_bpe_50k.json"), bpe.vocabulary("word_bpe_49k.json")
    assert content_sort.content_sort(empty).count() == 0
    assert feistel.shard(empty).count() == 0
    assert bpe.encode(empty, path, decoded=True).count() == 0
    assert packing.pack(packing.token_ids(empty, wpath)).count() == 0
    assert jaccard.near_duplicates(empty).count() == 0
    assert pii.spans_by_row(pii.find(empty)).count() == 0 and pii.redact(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(pages, spark.createDataFrame([], "number long, verdict string")).count() == 0
    assert blocks.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
