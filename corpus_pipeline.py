"""A corpus pipeline of five stages over ``documents``; part of the subpackage ``keyfold.llm``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and all but the last return the columns of ``documents``.

Defined cases, for every stage: other columns of ``docs``, whatever their names,
are left out; null and empty texts are worked on as empty and stay null or empty
(as many as the stages below let through); very long texts are worked on whole;
rows are judged one by one, so that repeated or null identifiers neither join
nor part them; ties are decided as each stage says; an empty table gives an
empty result. A stage reads ``docs`` more than once: it should be a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import content_sort, fm, jaccard, packing, pii
from keyfold.llm.bpe import vocabulary
from keyfold.llm.shared import saved, scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores below 0.5 go.

    Rows with equal texts and ``n_chars`` go or stay together; null and empty
    texts are scored by their statistics; a null identifier has no label and is
    scored like others; without labels all stay.
    """
    model = fm.quality_model(spark, docs, sf_dir)
    return fm.score(docs.select(*COLUMNS), model, metadata=("n_chars",)).filter("score >= 0.5").select(*COLUMNS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest identifier stays.

    Null and empty texts are equal to each other; a null identifier comes last;
    of rows equal in both, any one stays.
    """
    return content_sort.content_sort(docs, keep="smallest", carry=("text", "lang", "source", "n_chars"), kept_only=True).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 the one with the smallest identifier stays.

    Decided by row: a repeated or null identifier neither saves nor costs another text.
    Of rows equal in identifier and text one stays; a null identifier comes last;
    texts without words have no links and all stay.
    """
    return jaccard.without_near_copies(docs.select(*COLUMNS), n=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind, and ``n_chars`` follows the text (null stays null). No row goes."""
    out = pii.redact(docs.select(*COLUMNS))
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("long"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences; a null or empty text is the end token alone."""
    tokens = packing.token_ids(docs, vocabulary("word_bpe_49k.json"))
    return packing.pack(tokens, keep=lambda ids: {"ids_crc32": F.crc32(ids)}).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("personal data", personal_data),
    ("best-fit packing", pack),
]

#: SQL can express neither the classifier nor the tokenizer; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:  # what a stage has written goes with it, but for its result
            docs = keep(saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-")))
    return STAGES[-1][1](spark, docs, sf_dir)
