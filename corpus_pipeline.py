"""A training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; all but the last return the columns of ``documents``.

Defined results, in every stage: an empty table gives an empty one; extra columns
are carried up to packing, whatever their names; rows with a null doc_id are
documents of their own, and rows that repeat are treated alike. A null text or one
without a letter goes in the first stage. Of equal or similar lines the first by
(doc_id, line) stays, and of near copies the smallest doc_id; rows that share that
doc_id all stay. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import language_id, line_dedup, near_dedup, packing, pii
from quillon.llm.common import Scratch, named, read_table, saved, sized
from quillon.llm.token_ids import tokenizer_path

KEY = b"corpus pipeline"


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """These columns, n_chars as long as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*map(named, columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without text or any letter go, and no others if no row can be learned from."""
    model = language_id.fit(docs)
    if model is None:
        return docs.where(language_id.has_letter(F.col("text").cast("string")))
    found = language_id.predict(docs, model)
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select(*map(named, docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that came before; those of which nothing is left go."""
    found = line_dedup.dedup_lines(docs)
    return _with_length(found.where((F.col("n_lines_removed") == 0) | F.col("text").rlike(r"[\p{L}\p{M}\p{N}_]")), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id."""
    gone = near_dedup.near_duplicates(docs).where(~F.col("kept") & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("__gone"))
    table = sized(Scratch(gone.distinct(), "near-copies"))
    return docs.join(table, docs["doc_id"].cast("long") == table["__gone"], "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data and secrets."""
    return _with_length(pii.pseudonymise(docs, KEY), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-id sequences of power-of-two lengths, with their ids."""
    pieces = packing.pack(docs, tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("packing", pack),
]

#: SimHash lines, MinHash and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what each stage returns is written and read again as the next one's documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
