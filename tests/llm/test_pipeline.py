"""The pipeline against a plain version of its stages, on the smallest tables."""

import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyfold.llm import bpe, queries, words
from keyfold.llm.shared import table
from tests.llm.test_operators import PLAIN, plain_components, plain_sets, plain_spans, whole

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with nulls in every column, empty and very long texts, ties, repeats and clashing names, and labels."""
    sf = f"file://{tmp_path_factory.mktemp('sf')}"
    story = lambda i, n=60: " ".join(f"word{(i * 7 + k * k) % 97}" for k in range(n))
    rows = [(i, story(i), "en", "web", 300) for i in range(40)]
    rows += [(100, story(3) + " x", "en", "web", 300), (100, "an unrelated text of its own with the same number", None, None, None), (None, story(5) + " y", None, "web", 1), (None, "a text without a number", "de", None, 2)]
    rows += [(7, story(7), "en", "web", 300), (7, story(7), "en", "web", 300), (200, None, "en", "web", None), (201, "", None, None, 0), (201, "", None, None, 0), (202, " \n", "en", "a", 2), (203, "long " * 60_000 + "end a@b.org", "en", "b", 300_011)]
    rows += [(300 + i, "BUY!! " * (40 + i), "en", "spam", 240) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("score", "_text", "_doc", "_row", "_id", "_ids", "k1", "k2", "keep_id", "_cuts", "piece", "ids", "id", "label"):
        df = df.withColumn(name, F.lit("clash"))
    df.repartition(5).write.parquet(f"{sf}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(300 + i, 0, 0) for i in range(20)] + [(None, 1, None), (1, None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return sf


def test_stages_on_odd_rows(spark, odd):
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, odd, "documents")
    row = lambda r: tuple(r[c] for c in corpus_pipeline.COLUMNS)
    everything = [row(r) for r in docs.collect()]

    good = stages["quality classifier"](spark, docs, odd)
    assert good.columns == corpus_pipeline.COLUMNS
    assert not [r for r in good.collect() if (r["text"] or "").startswith("BUY")] and {r["doc_id"] for r in good.collect()} >= set(range(40))

    once = [row(r) for r in stages["exact dedup"](spark, docs, odd).collect()]
    by_text = defaultdict(list)
    for r in everything:
        by_text[r[1] or ""].append(r)
    assert len(once) == len(by_text)
    for r in once:
        ids = [x[0] for x in by_text[r[1] or ""] if x[0] is not None]
        assert r in by_text[r[1] or ""] and r[0] == (min(ids) if ids else None)

    near = [row(r) for r in stages["n-gram Jaccard join"](spark, docs, odd).collect()]
    sets = plain_sets([(k, r[1]) for k, r in enumerate(everything)], 5)
    component = plain_components(sets, 80)
    groups = defaultdict(list)
    for k, s in sets:
        groups[component[k] if s else -k - 1].append(everything[k])
    assert len(near) == len(groups)
    last = lambda r: (r[0] is None, r[0] or 0)
    stays = sorted(last(min(g, key=last)) for g in groups.values())
    assert sorted(map(last, near)) == stays
    assert sum(r[1] == "an unrelated text of its own with the same number" for r in near) == 1 and not [r for r in near if (r[1] or "").endswith((" x", " y")) and "word" in r[1]]

    clean = stages["personal data"](spark, docs, odd)
    assert clean.columns == corpus_pipeline.COLUMNS
    got = defaultdict(int)
    for r in clean.collect():
        got[row(r)] += 1
    for r in everything:
        text = r[1].replace("a@b.org", "[EMAIL]") if r[1] else r[1]
        assert got[r[0], text, r[2], r[3], len(text) if r[4] is not None and text is not None else None] > 0, r
    assert sum(got.values()) == len(everything)

    pieces = stages["best-fit packing"](spark, docs, odd).collect()
    library = words.Encoder(bpe.vocabulary("word_bpe_49k.json")).library
    want = defaultdict(int)
    for r in everything:
        n = len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1
        for k in range(0, n, 4096):
            want[r[0], k, min(4096, n - k)] += 1
    have = defaultdict(int)
    for r in pieces:
        have[r["doc_id"], r["start"], r["length"]] += 1
    assert have == want


def test_stages_on_an_empty_table(spark, odd):
    docs = table(spark, odd, "documents").filter("doc_id = -1")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, odd).count() == 0, name


def test_run_leaves_no_scratch(spark, odd):
    from keyfold import common

    common.drop_saved(spark)
    out = corpus_pipeline.run(spark, odd)
    assert out.count() > 0
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in common._written]
    assert sorted(set(left)) == ["numbered", "pieces", "stage-exact-dedup", "stage-n-gram-Jaccard-join", "stage-personal-data", "stage-quality-classifier"]


@tables
def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == [n for n, _ in corpus_pipeline.STAGES] and len(stages) == 5
    good = stages["quality classifier"](spark, docs, SF)
    assert good.columns == docs.columns
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    known = [i for i in labels if labels[i] is not None]
    assert np.mean([(i in kept) == bool(labels[i]) for i in known]) > 0.9

    first = {}
    for i, t in sorted(kept.items()):
        first.setdefault(whole(t), i)
    unique = {i: kept[i] for i in first.values()}
    again = {r["doc_id"]: r["text"] for r in stages["exact dedup"](spark, good, SF).collect()}
    assert again == unique

    component = plain_components(plain_sets(sorted(unique.items()), 5), 80)
    want = {i: t for i, t in unique.items() if component[i] == i}
    frame = stages["exact dedup"](spark, good, SF)
    near = stages["n-gram Jaccard join"](spark, frame, SF)
    assert {r["doc_id"]: r["text"] for r in near.collect()} == want

    clean = stages["personal data"](spark, near, SF)
    assert clean.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert texts.keys() == want.keys()
    for i, t in texts.items():
        assert not re.search(PLAIN["email"], t)
        if not plain_spans(want[i]) and "_LIKE]" not in t:
            assert t == want[i]

    library = words.Encoder(bpe.vocabulary("word_bpe_49k.json")).library
    pieces = stages["best-fit packing"](spark, clean, SF).collect()
    expected = {}
    for i, t in texts.items():
        ids = [*library.encode(whole(t), add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            expected[i, k // 4096] = (k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in pieces} == expected
    by = defaultdict(list)
    for r in pieces:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096


@tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    want = sorted(str(sorted(dict(zip(names, r)).items())) for r in cur.fetchall())
    assert sorted(str(sorted(r.asDict().items())) for r in queries.QUERIES[name](spark, SF).collect()) == want


@tables
def test_queries_return_what_they_promise(spark):
    columns = {
        "op1_factorisation_machine": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op3_ftrl_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
        "op4_weak_supervision_pii": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
        "op5_association_rules": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
        "op7_word_table_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
        "op8_feistel_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
        "op9_best_two_fit": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    }
    for name, kinds in columns.items():
        assert dict(queries.QUERIES[name](spark, SF).dtypes) == kinds, name
