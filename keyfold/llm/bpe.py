"""Byte-pair encoding and decoding of a corpus with a distinct-word table.

Spark splits every text into words and counts the distinct ones; the most
frequent (``table_words`` at most, none longer than ``word_bytes``) are encoded
once by the tokenizers library and form a table of bounded size that every task
gets. A second pass splits the texts again and joins the words' ids back by
position, a whole Arrow batch at a time. A distinct word outside the table,
which is rare by construction, is encoded by the library where it stands and
then kept in the worker's own table, which has a bound as well. Decoding joins each id with its piece in the
vocabulary.

Defined cases: a null text counts as empty and has no ids; repeated rows, null
or repeated identifiers and very long texts are encoded like any other; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm.shared import saved, table, whole_text
from keyfold.llm.words import Encoder, bytes_of, encoder, grouped, slices, split


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (binary), n: how often each distinct word occurs in all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0):
            words, _ = split(b.column(0))
            n = words.value_counts()
            yield pa.RecordBatch.from_arrays([n.field("values").cast(pa.binary()), n.field("counts")], names=["word", "n"])

    return docs.select(whole_text(text_col).alias("text")).mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, path: str, text_col: str = "text", table_words: int = 1 << 19, word_bytes: int = 48) -> DataFrame:
    """word, n, ids of the most frequent words: as many whole counts n as fit into ``table_words``."""
    counts = saved(word_counts(docs, text_col).filter((F.octet_length("word") <= word_bytes) & (F.col("n") > 1)), "word_counts")
    least, room = 1 << 62, table_words
    # how many words occur n times: n above 1000 in steps, so that this stays small
    step = F.when(F.col("n") < 1000, F.col("n")).otherwise((F.floor(F.log10("n") * 100) * 1000).cast("long"))
    for n, low, many in sorted(map(tuple, counts.groupBy(step.alias("s")).agg(F.min("n"), F.count("*")).collect()), key=lambda r: -r[1]):
        if many > room:
            break
        least, room = low, room - many

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = Encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), library.library_ids(b.column(0).cast(pa.large_binary())).cast(pa.binary())], names=["word", "n", "ids"])

    return counts.filter(F.col("n") >= least).mapInArrow(encoded, "word binary, n long, ids binary")


def byte_pieces(path: str) -> pa.Array:
    """The bytes of each id of a byte-level vocabulary."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # fixed values: byte-level vocabularies show a printable byte as itself and the others from U+0100 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(shown))}
    names = {i: s for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    piece = lambda s: bytes(byte_of[c] for c in s) if all(c in byte_of for c in s) else s.encode()
    return pa.array([piece(names.get(i, "")) for i in range(max(names) + 1)], pa.large_binary())


def texts_of(ids: pa.Array, pieces: pa.Array) -> pa.Array:
    """Join each id with its piece; bytes that are no UTF-8 become U+FFFD, as in the library."""
    data, at = bytes_of(ids, np.arange(len(ids) + 1))
    flat = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]].view("<u4")
    out, ends = bytes_of(pieces.take(pa.array(flat)), (at - at[0]) // 4)
    return pa.array([bytes(out[i:j]).decode("utf-8", "replace") for i, j in zip(ends[:-1], ends[1:])], pa.string())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", table_words: int = 1 << 19, decoded: bool = False) -> DataFrame:
    """id and ``ids`` (little-endian unsigned 32-bit integers) of every row; with ``decoded`` also their text, made in the same task."""
    spark = docs.sparkSession
    known = word_table(docs, path, text_col, table_words).select("word", "ids").toArrow().combine_chunks()
    version = uuid.uuid4().hex
    sent = spark.sparkContext.broadcast((known.column(0).cast(pa.large_binary()).combine_chunks(), known.column(1).cast(pa.large_binary()).combine_chunks()))
    pieces = byte_pieces(path) if decoded else None

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, table_words + (1 << 17), version, *sent.value)
        for b in slices(batches, 1):
            words, starts = split(b.column(1))
            found = grouped(own.encode(words), starts)
            cols = {id_col: b.column(0), "ids": found.cast(pa.binary())}
            if decoded:
                cols["decoded"] = texts_of(found, pieces)
            yield pa.RecordBatch.from_pydict(cols)

    rows = docs.select(F.col(id_col), whole_text(text_col).alias("text"))
    return rows.mapInArrow(ids, f"`{id_col}` {dict(rows.dtypes)[id_col]}, ids binary" + ", decoded string" * decoded)


def decode(rows: DataFrame, path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids."""
    pieces = byte_pieces(path)  # bounded by the vocabulary
    others = [c for c in rows.columns if c != name]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, others.index(ids_col)):
            text = texts_of(b.column(b.schema.get_field_index(ids_col)).cast(pa.large_binary()), pieces)
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(c)) for c in others], text], names=[*others, name])

    kinds = dict(rows.dtypes)
    return rows.select(*others).mapInArrow(texts, ", ".join(f"`{c}` {kinds[c]}" for c in others) + f", `{name}` string")


def op7_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    out = encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return out.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
