"""A training-data pipeline: quality rules, near duplicates, repeated strings, source mix, piece ids.

Each stage takes (spark, docs, sf_dir), works on all rows it is given and returns a DataFrame that is written and
read again as the next stage's ``docs``; all but the last return the columns of ``documents``, and columns beyond those are ignored.

Nulls are kept as they are in any column, a null doc_id included (such a row is a document of its own: the quality rules and the mix
treat it as any other, nothing is linked with it or hidden by it). A null or empty text fails the quality rules; later stages pass it
on. Rows that repeat a doc_id are documents of their own, but near duplicates link ids: such rows go or stay together. An empty
table passes through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import pieces
from lexloom.llm.mixing import mix_sources
from lexloom.llm.near_dedup import near_duplicates
from lexloom.llm.quality import passing
from lexloom.llm.queries import PIECES
from lexloom.llm.repeats import remove_repeats, twins
from lexloom.llm.sieve import sieve
from lexloom.session import cut, prepare

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with the text of the lines that passed."""
    out = passing(docs.select(*COLUMNS)).withColumn("text", F.col("clean_text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near duplicates, linked from similarity 0.8 on (of equal ones the smallest doc_id)."""
    docs = docs.select(*COLUMNS)
    gone = cut(near_duplicates(docs, percent=80).filter("not kept").select("doc_id"))
    return sieve(docs, "doc_id", gone, inverse=True).union(sieve(docs, "doc_id", gone).join(gone, "doc_id", "left_anti"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that an earlier string covers; documents that lose everything stay, empty.

    Nulls, empty texts and a null doc_id pass as they are; rows that repeat a doc_id are documents of their own."""
    rows = twins(docs, ("lang", "source", "n_chars"))
    new = cut(remove_repeats(rows).select("doc_id", "twin", "kept_text"))
    some = sieve(rows, "doc_id", new).join(new, ["doc_id", "twin"], "left").withColumn("n_chars", F.when(F.col("kept_text").isNull(), F.col("n_chars")).otherwise(F.length("kept_text").cast("long")))
    some = some.withColumn("text", F.coalesce("kept_text", "text"))
    return sieve(rows, "doc_id", new, inverse=True).select(*COLUMNS).union(some.select(*COLUMNS))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    docs = docs.select(*COLUMNS)
    mixed = mix_sources(docs, keep=("text", "lang", "n_chars")).filter("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*COLUMNS)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, token_ids, and whether decoding gives the text back."""
    hashed = docs.withColumn("sha", F.sha2("text", 256))
    back = pieces.round_trip(hashed, PIECES, ("source", "sha")).withColumn("n_tokens", F.size("ids").cast("long"))
    return back.select("doc_id", "source", "n_tokens", F.col("ids").alias("token_ids"), F.col("sha").eqNullSafe(F.sha2("text", 256)).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("repeated_strings", repeated_strings),
    ("source_mix", source_mix),
    ("piece_ids", piece_ids),
]
#: Near duplicates, suffix comparison and Viterbi have no SQL form; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read again."""
    prepare(spark)
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
