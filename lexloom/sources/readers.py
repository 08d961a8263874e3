"""Readers and sinks of the corpus formats."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from lexloom.session import cut

TEXT_FIELDS = ("text", "sentence", "transcript", "transcription")


class BrokenLine(ValueError):
    """A line that is no JSON, with its file and number."""


def jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines under a schema. Broken lines stay in ``_corrupt_record``; ``strict`` raises on the first of them, by file and line number."""
    both = StructType([*_schema(schema).fields, *_schema("_corrupt_record string").fields])
    rows = spark.read.schema(both).json(path, mode="PERMISSIVE", recursiveFileLookup=True)
    if not strict:
        return rows
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("i"))
    bad = lines.withColumn("_r", F.from_json("value", both, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})).filter("trim(value) != '' and _r._corrupt_record is not null").orderBy("file", "i").limit(1).collect()
    if bad:
        ahead = lines.filter((F.col("file") == bad[0]["file"]) & (F.col("i") < bad[0]["i"])).count()
        raise BrokenLine(f"{bad[0]['file']}, line {ahead + 1}: {bad[0]['value'][:80]!r}")
    return rows.drop("_corrupt_record")


def _schema(s: StructType | str) -> StructType:
    return s if isinstance(s, StructType) else StructType.fromDDL(s)


def manifest(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Rows of a Parquet file, a JSON lines file, or a tree of either, with the file each came from and its place there (``_file``, ``_row``)."""
    tree = spark.read.option("recursiveFileLookup", "true")
    if path.endswith((".jsonl", ".json")) or not path.endswith(".parquet") and schema is not None:
        rows = tree.schema(_schema(schema)).json(path) if schema is not None else tree.json(path)
        return rows.withColumn("_file", F.col("_metadata.file_path")).withColumn("_block", F.col("_metadata.file_block_start")).withColumn("_row", F.monotonically_increasing_id())
    return tree.parquet(path).withColumn("_file", F.col("_metadata.file_path")).withColumn("_block", F.lit(-1).cast("long")).withColumn("_row", F.col("_metadata.row_index"))


def indexed(df: DataFrame, name: str) -> DataFrame:
    """Rows of ``manifest`` with their number in their file. Parquet knows it; lines are numbered within their block of the file, from the
    counts of the blocks in front of it, so no task holds a file."""
    sizes = df.groupBy("_file", "_block").agg(F.min("_row").alias("_lo"), F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = sizes.withColumn("_ahead", ahead).drop("_n")  # a row for each block of a file
    return df.join(blocks, ["_file", "_block"]).withColumn(name, F.when(F.col("_block") < 0, F.col("_row")).otherwise(F.col("_row") - F.col("_lo") + F.col("_ahead"))).drop("_lo", "_ahead")


def with_row_ids(df: DataFrame, root: str) -> DataFrame:
    """Rows of ``manifest`` with ``<relative file>:<index>``; the index counts a file's rows by their place in it."""
    name = F.regexp_replace("_file", f"^(file:/*)?/?{root.strip('/')}/", "")
    return indexed(df, "_index").withColumn("row_id", F.concat_ws(":", name, F.col("_index").cast("string")))


def shard_slice(df: DataFrame, index: Column, shard: int, shards: int) -> DataFrame:
    return df.filter(F.pmod(index, F.lit(shards)) == shard)


def partition_rows(df: DataFrame, rank: int, ranks: int) -> DataFrame:
    """Rank's share of the rows of ``manifest``: whole files, if there are at least as many as ranks, else every ranks-th row. Shares are complete and disjoint."""
    if not 0 <= rank < ranks:
        raise ValueError("rank out of range")
    files = sorted({r[0] for r in df.select("_file").distinct().collect()})  # one row a file
    if len(files) >= ranks:
        return df.filter(F.col("_file").isin(files[rank::ranks]))
    return indexed(df, "_n").filter(F.pmod("_n", F.lit(ranks)) == rank).drop("_n")


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated without quoting."""
    return spark.read.csv(path, sep="\t", header=True, quote="")


def sentences(spark: SparkSession, path: str) -> DataFrame:
    """Held-out sentences from .txt, .json(l), .csv or .tsv; the first field present of TEXT_FIELDS."""
    kind = path.rsplit(".", 1)[-1]
    if kind == "txt":
        df = spark.read.text(path).withColumnRenamed("value", "text")
    elif kind in ("json", "jsonl"):
        df = spark.read.json(path, multiLine=kind == "json")
    else:
        df = spark.read.csv(path, sep="\t" if kind == "tsv" else ",", header=True)
    found = [F.nullif(F.trim(F.col(c)), F.lit("")) for c in TEXT_FIELDS if c in df.columns]
    if not found:
        raise ValueError(f"{path} has none of {TEXT_FIELDS}")
    return df.select(F.coalesce(*found).alias("text")).filter("text is not null")


def shard_list(spec: str) -> list[int]:
    """"0-2,5" -> 0, 1, 2, 5."""
    out: list[int] = []
    for part in spec.split(","):
        low, _, high = part.strip().partition("-")
        out += range(int(low), int(high or low) + 1)
    return sorted(set(out))


def utterance_parts(c: Column) -> dict[str, Column]:
    """``<video>-<index>-<start>-<end>`` in centiseconds, split from the right."""
    at = lambda k: F.regexp_extract(c, r"^(.*)-(\d+)-(\d+)-(\d+)$", k)
    return {"video": at(1), "index": F.try_to_number(at(2), F.lit("9999999999")).cast("long"), "start": at(3).try_cast("double") / 100, "end": at(4).try_cast("double") / 100}


def refuse_held_out(names: list[str], forbidden: tuple[str, ...] = ("eval", "test-only", "noncommercial")) -> None:
    """Stops before anything is read from a source that must not be used."""
    for name in names:
        for word in forbidden:
            if word in name.lower():
                raise ValueError(f"source {name!r} is refused: {word}")


def write_manifest(df: DataFrame, path: str, rows: int = 10_000) -> None:
    """Parquet parts of bounded rows; an existing output is an error, _SUCCESS comes last."""
    df.write.option("maxRecordsPerFile", rows).mode("errorifexists").parquet(path)


def split_rejected(df: DataFrame, kept: str, rejected: str, reason: str = "reason") -> None:
    """Rows without a reason as Parquet, the others as JSON lines with theirs."""
    df = cut(df)  # computed once for both
    df.filter(F.col(reason).isNull()).drop(reason).write.mode("errorifexists").parquet(kept)
    df.filter(F.col(reason).isNotNull()).write.mode("errorifexists").json(rejected)


class PackedWriter:
    """Float16 shards for export: rows of one width packed one after the other, a new shard at ``limit`` bytes; each ``write`` returns (shard, offset in rows)."""

    def __init__(self, folder: str, width: int, limit: int = 512 << 20):
        self.folder, self.width, self.limit, self.number, self.rows, self.file = folder, width, limit, -1, 0, None

    def write(self, values: np.ndarray) -> tuple[str, int]:
        if values.ndim != 2 or values.shape[1] != self.width or not len(values):
            raise ValueError(f"expected rows of {self.width} values")
        packed = values.astype("<f2")
        if not np.isfinite(packed).all():
            raise ValueError("values that are not finite in half precision")
        if self.file is None or (self.rows and (self.rows + len(packed)) * self.width * 2 > self.limit):
            self.close()
            self.number, self.rows = self.number + 1, 0
            self.file = open(f"{self.folder}/shard-{self.number:05d}.bin", "xb")
        at, self.rows = self.rows, self.rows + len(packed)
        self.file.write(packed.tobytes())
        return self.file.name, at

    def close(self) -> None:
        if self.file:
            self.file.close()
            self.file = None


def pack_shards(df: DataFrame, key: str, vectors: str, width: int, folder: str, limit: int = 512 << 20) -> DataFrame:
    """key, shard, offset, frames: arrays of frames packed by each task into shards of its own under a shared folder."""
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = f"{folder}/{uuid.uuid4().hex}"  # a task that runs again writes anew and its rows name the new files
        os.makedirs(place)
        writer = PackedWriter(place, width, limit)
        for f in frames:
            at = [writer.write(np.stack([np.asarray(x) for x in v])) for v in f[vectors]]
            yield pd.DataFrame({key: f[key], "shard": [a for a, _ in at], "offset": [b for _, b in at], "frames": [len(v) for v in f[vectors]]})
        writer.close()

    return df.select(key, vectors).mapInPandas(run, f"{key} {kind}, shard string, offset long, frames long")


def runs_table(runs: dict[str, DataFrame]) -> DataFrame:
    """One-row summaries of many runs as one table; columns that no run has a value for are left out."""
    rows = None
    for name, df in runs.items():
        part = df.limit(1).withColumn("run", F.lit(name))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    have = rows.agg(*(F.count(c).alias(c) for c in rows.columns)).first()
    return rows.select("run", *(c for c in rows.columns if c != "run" and have[c]))


def write_tsv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.option("sep", "\t").option("header", "true").option("quote", "").mode("errorifexists").csv(path)


def resume(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that an earlier run has not written."""
    return df.join(done.select(key), key, "left_anti")


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small report as a Markdown table; one of more than ``limit`` rows is an error."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report of more than {limit} rows is not one to read: write it as a table")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows])


def summary_json(df: DataFrame) -> str:
    """A one-row DataFrame as sorted JSON."""
    return json.dumps(df.first().asDict(recursive=True), sort_keys=True, default=str)
