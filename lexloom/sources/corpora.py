"""Candidates of the corpora: clips with votes, folders of sound and text, shards of utterances, long recordings, paired members, speaker lists."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.sources.readers import tsv, utterance_parts

CLIP_META = ("sentence_id", "up_votes", "down_votes", "age", "gender", "accents", "variant", "locale", "segment", "sentence_domain")


def clip_durations(spark: SparkSession, path: str) -> DataFrame:
    """clip, duration in seconds, from a table of milliseconds."""
    d = tsv(spark, path)
    name = "duration[ms]" if "duration[ms]" in d.columns else "duration"
    return d.select("clip", (F.col(f"`{name}`").cast("double") / 1000).alias("duration")).filter("clip is not null and duration is not null")


def voted_clips(spark: SparkSession, folder: str, listing: str, locale: str, max_down: int = 0) -> DataFrame:
    """id, text, speaker, path, duration, meta, reject of a folder of validated clips: too many votes against, or another locale, is a reason to reject."""
    rows = tsv(spark, f"{folder}/{listing}")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) if c in rows.columns else F.lit("")
    down = F.coalesce(F.try_to_number(F.trim(blank("down_votes")), F.lit("9999999999")).cast("long"), F.lit(0))
    reject = F.when(down > max_down, "down_votes").when((blank("locale") != "") & (blank("locale") != locale), "locale")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    meta = F.map_filter(F.create_map(*(x for c in CLIP_META if c in rows.columns for x in (F.lit(c), F.col(c)))), lambda _, v: v.isNotNull() & (v != ""))
    out = rows.select(
        F.concat(F.lit(f"common-voice/{locale}/"), stem).alias("id"), blank("sentence").alias("text"),
        F.when(blank("client_id") != "", F.concat(F.lit("cv/"), blank("client_id"))).otherwise("").alias("speaker"),
        F.concat(F.lit(f"{folder}/clips/"), "path").alias("path"), F.col("path").alias("clip"), meta.alias("meta"), reject.alias("reject"),
    )
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/clip_durations.tsv")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return out.withColumn("duration", F.lit(None).cast("double")).drop("clip")
    return out.join(clip_durations(spark, f"{folder}/clip_durations.tsv"), "clip", "left").drop("clip")


def sidecar_clips(spark: SparkSession, root: str, splits: list[str], speaker: str | None = None, name: str = "tsc") -> DataFrame:
    """Sound files with a text beside each of them, below <root>/<split> in any case; the first group of ``speaker`` names who speaks.

    Contents of sound files are not read here: only their paths are.
    """
    at = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(root).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    texts = texts.select(F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), "^file:/*", "/"), r"\.txt$", "").alias("key"), F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("text"), F.lit(True).alias("found"))
    relative = F.substring("path", len(root.rstrip("/")) + 2, 1 << 20)
    rows = at.withColumn("relative", relative).withColumn("split", F.element_at(F.split("relative", "/"), 1)).filter(F.lower("split").isin(*(s.lower() for s in splits)))
    rows = rows.withColumn("key", F.regexp_replace("path", r"\.wav$", "")).withColumn("stem", F.element_at(F.split("key", "/"), -1)).join(texts, "key", "left")
    missing = F.when(F.col("found").isNull(), "missing_transcript")
    who = F.regexp_extract("stem", speaker, 1) if speaker else F.col("stem")
    reject = F.coalesce(missing, F.when(who == "", "speaker_regex")) if speaker else missing
    rest = F.regexp_replace(F.substring(F.col("relative"), 1, 1 << 20), r"\.wav$", "")
    return rows.select(
        F.concat(F.lit(f"issai-{name}/"), rest).alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit(f"{name}/"), F.when(who == "", F.col("stem")).otherwise(who)).alias("speaker"),
        "path", F.col("relative").alias("source_recording"), "split", reject.alias("reject"),
    )


def side_files(spark: SparkSession, text: str, duration: str) -> DataFrame:
    """utt, text, duration of an utterance shard's two side files; a line is an id, a blank, and the rest."""
    def lines(path: str, name: str) -> DataFrame:
        v = F.trim("value")
        return spark.read.text(path).filter(v != "").select(F.regexp_extract(v, r"^(\S+)", 1).alias("utt"), F.regexp_extract(v, r"^\S+\s+(.*)$", 1).alias(name))

    seconds = lines(duration, "d").filter(F.col("d").rlike(r"^\S+$")).select("utt", F.col("d").try_cast("double").alias("duration"))
    return lines(text, "text").join(seconds, "utt", "left")


def utterance_clips(members: DataFrame, sides: DataFrame, subset: str) -> DataFrame:
    """Members of utterance archives (archive, member, content) with their text, place in the recording and length; members without a text go."""
    stem = F.regexp_replace(F.element_at(F.split("member", "/"), -1), r"\.[^.]*$", "")
    rows = members.withColumn("utt", stem).join(sides, "utt")
    parts = utterance_parts(F.col("utt"))
    return rows.select(F.concat(F.lit(f"yodas/{subset}/"), "utt").alias("id"), "text", "duration", parts["video"].alias("session_id"), parts["start"].alias("start_seconds"), parts["end"].alias("end_seconds"), F.concat_ws(":", "archive", "member").alias("source_recording"), "content")


def long_recordings(spark: SparkSession, listing: str) -> DataFrame:
    """audio_id, utt, text, start, end of every utterance in a JSON list of long recordings (audio_id, text: map of utterance to text)."""
    rows = spark.read.schema("audio_id string, text map<string,string>").json(listing, multiLine=True)
    rows = rows.select("audio_id", F.explode("text").alias("utt", "text"))
    parts = utterance_parts(F.col("utt"))
    return rows.select("audio_id", "utt", "text", parts["start"].alias("start_seconds"), parts["end"].alias("end_seconds"))


def cut_spans(samples: Column, rate: Column, start: Column, end: Column) -> Column:
    """The samples of a stretch of a recording, in whole samples."""
    a, b = F.bround(start * rate).cast("int"), F.bround(end * rate).cast("int")
    return F.slice(samples, a + 1, F.greatest(b - a, F.lit(0)))


def paired_members(members: DataFrame) -> DataFrame:
    """key, flac, metadata: members of archives put together by their name; only whole pairs stay. Conditional aggregates, no join."""
    base = F.element_at(F.split("member", "/"), -1)
    key = F.concat_ws("/", "archive", F.regexp_replace("member", r"[^/]*$", ""), F.regexp_extract(base, r"^([^.]*)", 1))
    kind = F.regexp_extract(base, r"^[^.]*\.(.*)$", 1)
    rows = members.select(key.alias("key"), kind.alias("kind"), "content").filter(F.col("kind").isin("flac", "metadata.json"))
    both = rows.groupBy("key").agg(*(F.first(F.when(F.col("kind") == k, F.col("content")), ignorenulls=True).alias(n) for k, n in (("flac", "flac"), ("metadata.json", "metadata"))))
    return both.filter("flac is not null and metadata is not null")


def utterances_of(metadata: str) -> list[tuple[str, str, float, float]]:
    """utt, text, start, end of a recording's metadata, which has a list of records or a record of lists."""
    found = json.loads(metadata).get("utterances") or []
    if isinstance(found, dict):
        found = [dict(zip(found, values, strict=False)) for values in zip(*found.values(), strict=False)]
    return [(u["utt_id"], u["text"], float(u["start"]), float(u["end"])) for u in found]


def paired_utterances(pairs: DataFrame) -> DataFrame:
    """key, utt, text, start_seconds, end_seconds of ``paired_members``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, *u) for k, m in zip(f["key"], f["metadata"], strict=True) for u in utterances_of(bytes(m).decode())]
            yield pd.DataFrame(rows, columns=["key", "utt", "text", "start_seconds", "end_seconds"])

    return pairs.select("key", "metadata").mapInPandas(run, "key string, utt string, text string, start_seconds double, end_seconds double")


def speaker_list(spark: SparkSession, path: str) -> DataFrame:
    """speaker: a JSON list, the keys of a JSON object, or one a line. Names that are no text are an error."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if not text.lstrip().startswith(("[", "{")):
        return spark.read.text(path).select(F.trim("value").alias("speaker")).filter("speaker != ''").distinct()
    found = list(json.loads(text))
    if not all(isinstance(x, str) for x in found):
        raise ValueError(f"{path}: expected a list of names or an object of them")
    return spark.createDataFrame([(x,) for x in sorted(set(found))], "speaker string")
