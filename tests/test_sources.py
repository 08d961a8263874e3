"""Readers, sinks and corpus sources on files."""

import io
import json
import math
import tarfile

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lexloom.operators import prepare as P
from lexloom.sources import corpora, footers, readers


def test_jsonl_names_the_broken_line(spark, tmp_path):
    good = tmp_path / "a.jsonl"
    good.write_text('{"id": 1}\n{"id": 2}\n')
    assert sorted(r["id"] for r in readers.jsonl(spark, str(good), "id long").collect()) == [1, 2]
    bad = tmp_path / "b.jsonl"
    bad.write_text('{"id": 1}\n{"id": 2}\n{"id": oops\n{"id": 4}\n')
    with pytest.raises(readers.BrokenLine, match="b.jsonl, line 3"):
        readers.jsonl(spark, str(bad), "id long")
    assert [r["_corrupt_record"] for r in readers.jsonl(spark, str(bad), "id long", strict=False).collect() if r["_corrupt_record"]] == ['{"id": oops']


@pytest.mark.parametrize("files, ranks", [(1, 8), (3, 2), (8, 8)])
def test_partitions_are_complete_and_disjoint(spark, tmp_path, files, ranks):
    at = f"{tmp_path}/m"
    for k in range(files):
        spark.range(k * 31, (k + 1) * 31).coalesce(1).write.mode("append").parquet(at)
    rows = readers.manifest(spark, at)
    parts = [{r["id"] for r in readers.partition_rows(rows, k, ranks).collect()} for k in range(ranks)]
    assert sum(map(len, parts)) == len(set().union(*parts)) == 31 * files
    named = readers.with_row_ids(rows, at).select("row_id").distinct()
    assert named.count() == 31 * files and named.filter("row_id like '%:30'").count() == files
    with pytest.raises(ValueError):
        readers.partition_rows(rows, ranks, ranks)


def test_json_manifests_and_digest(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.json").write_text('{"id": 1}\n{"id": 2}\n')
    assert readers.with_row_ids(readers.manifest(spark, f"{tmp_path}/x", "id long"), f"{tmp_path}/x").count() == 2
    one = P.inventory_digest(spark, f"{tmp_path}/x")
    assert one == P.inventory_digest(spark, f"{tmp_path}/x") and len(one) == 64
    (tmp_path / "x" / "b.json").write_text("{}")
    assert one != P.inventory_digest(spark, f"{tmp_path}/x")


def test_small_readers(spark, tmp_path):
    assert readers.shard_list("0-2,5") == [0, 1, 2, 5]
    (tmp_path / "t.tsv").write_text('a\tb\n"quoted\t2\n')
    assert readers.tsv(spark, f"{tmp_path}/t.tsv").first()["a"] == '"quoted'
    (tmp_path / "s.csv").write_text("id,sentence\n1,Bir\n2,\n")
    assert [r["text"] for r in readers.sentences(spark, f"{tmp_path}/s.csv").collect()] == ["Bir"]
    (tmp_path / "s.txt").write_text("Bir\n\nİki\n")
    assert readers.sentences(spark, f"{tmp_path}/s.txt").count() == 2
    (tmp_path / "s.jsonl").write_text('{"transcript": "Bir"}\n')
    assert readers.sentences(spark, f"{tmp_path}/s.jsonl").first()["text"] == "Bir"
    (tmp_path / "n.csv").write_text("id\n1\n")
    with pytest.raises(ValueError):
        readers.sentences(spark, f"{tmp_path}/n.csv")
    row = spark.createDataFrame([("vid-a-7-120-350",), ("odd",)], "u string").select(*(c.alias(k) for k, c in readers.utterance_parts(F.col("u")).items())).collect()
    assert tuple(row[0]) == ("vid-a", 7, 1.2, 3.5) and row[1]["index"] is None
    readers.refuse_held_out(["train-a"])
    with pytest.raises(ValueError):
        readers.refuse_held_out(["my-eval-set"])


def test_voted_clips(spark, tmp_path):
    (tmp_path / "v.tsv").write_text("client_id\tpath\tsentence\tup_votes\tdown_votes\tage\tlocale\nc1\ta.mp3\tBir \"iki\t2\t0\t\ttr\nc2\tb.mp3\tÜç\t2\t1\t20\ttr\n\tc.mp3\tDört\t2\tx\t\taz\n")
    (tmp_path / "clip_durations.tsv").write_text("clip\tduration[ms]\na.mp3\t1500\n")
    got = {r["id"]: r for r in corpora.voted_clips(spark, str(tmp_path), "v.tsv", "tr").collect()}
    a, b, c = (got[f"common-voice/tr/{k}"] for k in "abc")
    assert (a["text"], a["speaker"], a["duration"], a["reject"]) == ('Bir "iki', "cv/c1", 1.5, None) and "age" not in a["meta"]
    assert (b["reject"], b["duration"], b["meta"]["age"]) == ("down_votes", None, "20") and (c["speaker"], c["reject"]) == ("", "locale")


def test_sidecar_clips(spark, tmp_path):
    for name, text in (("Train/s1_a", " Bir \n"), ("Train/zz", None), ("Test/s2_b", "İki")):
        at = tmp_path / f"{name}.wav"
        at.parent.mkdir(exist_ok=True)
        at.write_bytes(b"RIFF")
        if text:
            at.with_suffix(".txt").write_text(text)
    got = {r["id"]: r for r in corpora.sidecar_clips(spark, str(tmp_path), ["train"], r"^(s\d+)_").collect()}
    assert set(got) == {"issai-tsc/Train/s1_a", "issai-tsc/Train/zz"}
    assert (got["issai-tsc/Train/s1_a"]["text"], got["issai-tsc/Train/s1_a"]["speaker"], got["issai-tsc/Train/s1_a"]["reject"]) == ("Bir", "tsc/s1", None)
    assert got["issai-tsc/Train/zz"]["reject"] == "missing_transcript"


def archive(path, members):
    with tarfile.open(path, "w") as tar:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def test_utterance_shards(spark, tmp_path):
    archive(tmp_path / "a.tar", {"x/v1-0-100-250.wav": b"one", "x/v1-1-300-400.wav": b"two", "x/v9-0-0-1.wav": b"none"})
    (tmp_path / "text").write_text("v1-0-100-250 Bir iki\nv1-1-300-400\n\n")
    (tmp_path / "dur").write_text("v1-0-100-250 1.5\nv1-1-300-400 x y\n")
    got = {r["id"]: r for r in corpora.utterance_clips(footers.tar_members(spark, f"{tmp_path}/a.tar"), corpora.side_files(spark, f"{tmp_path}/text", f"{tmp_path}/dur"), "tr").collect()}
    one, two = got["yodas/tr/v1-0-100-250"], got["yodas/tr/v1-1-300-400"]
    assert len(got) == 2 and (one["text"], one["duration"], one["session_id"], one["start_seconds"], bytes(one["content"])) == ("Bir iki", 1.5, "v1", 1.0, b"one")
    assert (two["text"], two["duration"]) == ("", None)


def test_many_members_leave_in_parts(spark, tmp_path):
    archive(tmp_path / "m.tar", {f"f{i}": b"x" * i for i in range(150)})
    assert footers.tar_members(spark, f"{tmp_path}/m.tar").agg(F.count("*"), F.sum(F.length("content"))).first()[:] == (150, 11175)


def test_long_recordings_and_pairs(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"audio_id": "v1", "text": {"v1-0-100-250": "Bir", "v1-1-300-400": "İki"}}]))
    rows = corpora.long_recordings(spark, f"{tmp_path}/l.json").orderBy("utt").collect()
    assert [(r["audio_id"], r["text"], r["start_seconds"]) for r in rows] == [("v1", "Bir", 1.0), ("v1", "İki", 3.0)]
    cut = spark.range(1).select(corpora.cut_spans(F.array(*map(F.lit, range(10))), F.lit(2), F.lit(1.0), F.lit(2.5)).alias("x")).first()["x"]
    assert cut == [2, 3, 4]
    meta = [{"utterances": [{"utt_id": "u1", "text": "Bir", "start": 0, "end": 1}]}, {"utterances": {"utt_id": ["u2", "u3"], "text": ["a", "b"], "start": [0, 1], "end": [1, 2]}}]
    archive(tmp_path / "p.tar", {"d/k1.flac": b"f1", "d/k1.metadata.json": json.dumps(meta[0]).encode(), "d/k2.metadata.json": json.dumps(meta[1]).encode(), "d/k2.flac": b"f2", "d/k3.flac": b"alone", "d/k3.txt": b"-"})
    pairs = corpora.paired_members(footers.tar_members(spark, f"{tmp_path}/p.tar"))
    assert pairs.count() == 2
    assert sorted(r["utt"] for r in corpora.paired_utterances(pairs).collect()) == ["u1", "u2", "u3"]


@pytest.mark.parametrize("text", ['["b", "a"]', '{"a": 1, "b": 2}', " a \n\nb\n"])
def test_speaker_lists(spark, tmp_path, text):
    (tmp_path / "s").write_text(text)
    assert sorted(r["speaker"] for r in corpora.speaker_list(spark, f"{tmp_path}/s").collect()) == ["a", "b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, "bad" if i % 4 == 0 else None) for i in range(20)], "id long, reason string")
    readers.split_rejected(df, f"{tmp_path}/kept", f"{tmp_path}/lost")
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 15 and spark.read.json(f"{tmp_path}/lost").count() == 5
    readers.write_manifest(df.select("id").coalesce(1), f"{tmp_path}/m", 6)
    assert len(list((tmp_path / "m").glob("*.parquet"))) == 4 and (tmp_path / "m" / "_SUCCESS").exists()
    with pytest.raises(Exception, match="(?i)exist"):
        readers.write_manifest(df, f"{tmp_path}/m")
    assert readers.resume(df, spark.read.parquet(f"{tmp_path}/kept"), "id").count() == 5
    table = readers.markdown(spark.createDataFrame([("a", 0.12345, None)], "k string, v double, n int"))
    assert table.splitlines() == ["| k | v | n |", "|---|---|---|", f"| a | {0.12345:.4g} |  |"]
    assert json.loads(readers.summary_json(df.agg(F.count("*").alias("n")))) == {"n": 20}
    runs = readers.runs_table({"r1": spark.createDataFrame([(1.0, None)], "wer double, cer double"), "r2": spark.createDataFrame([(2.0, "x")], "wer double, note string")})
    assert runs.columns == ["run", "wer", "note"] and runs.count() == 2
    readers.write_tsv(runs, f"{tmp_path}/runs")
    assert spark.read.csv(f"{tmp_path}/runs", sep="\t", header=True).count() == 2


def test_packed_shards(spark, tmp_path):
    writer = readers.PackedWriter(str(tmp_path), 4, limit=100)
    at = [writer.write(np.full((3, 4), k, np.float32)) for k in range(6)]
    writer.close()
    assert len({a for a, _ in at}) == 2 and [b for _, b in at] == [0, 3, 6, 9, 0, 3]
    back = np.fromfile(at[4][0], "<f2").reshape(-1, 4)
    assert (back[0:3] == 4).all() and len(back) == 6
    for wrong in (np.zeros((2, 3)), np.zeros((0, 4)), np.full((1, 4), np.inf), np.full((1, 4), 1e6)):
        with pytest.raises(ValueError):
            writer.write(wrong)
    frames = [(k, [[float(k + i)] * 4 for i in range(2 + k % 3)]) for k in range(20)]
    (tmp_path / "sh").mkdir()
    rows = readers.pack_shards(spark.createDataFrame(frames, "uid long, z array<array<float>>"), "uid", "z", 4, f"{tmp_path}/sh", 200).collect()
    for r in rows:
        data = np.fromfile(r["shard"], "<f2").reshape(-1, 4)[r["offset"] : r["offset"] + r["frames"]]
        assert data.tolist() == frames[r["uid"]][1] and not math.isnan(data.sum())


@pytest.mark.parametrize("files, group, ranks", [(3, 10, 2), (2, 10, 5), (1, 100, 7), (1, 100, 1)])
def test_row_groups_are_complete_and_disjoint(spark, tmp_path, files, group, ranks):
    """Shares by file, by row group and by row."""
    for k in range(files):
        pq.write_table(pa.table({"id": pa.array(range(k * 31, k * 31 + 31), pa.int64()), "t": [f"row {k}"] * 31, "at": pa.array([0] * 31, pa.timestamp("us"))}), f"{tmp_path}/{k}.parquet", row_group_size=group)
    parts = [[r["id"] for r in footers.row_groups(spark, str(tmp_path), ["id"], rank=k, ranks=ranks).collect()] for k in range(ranks)]
    assert sorted(sum(parts, [])) == list(range(31 * files)) and all(parts)
    whole = footers.row_groups(spark, str(tmp_path), chunk_bytes=1)
    assert whole.rdd.getNumPartitions() == files * -(-31 // group)  # a split for each row group
    assert footers.row_groups(spark, str(tmp_path), chunk_bytes=1 << 30).rdd.getNumPartitions() == files
    assert dict(whole.dtypes) == {"id": "bigint", "t": "string", "at": "timestamp_ntz"} and whole.count() == 31 * files
    with pytest.raises(Exception, match="rank out of range"):
        footers.row_groups(spark, str(tmp_path), rank=ranks, ranks=ranks).count()


def test_archives_are_read_by_stretches(spark, tmp_path):
    """Members with long names, folders and empty files; a task holds a run of members."""
    names = ["a/", "a/one.txt", "a/empty.txt", "b/" + "long" * 60 + ".txt", *(f"c/{i}.bin" for i in range(40))]
    for k in range(2):
        with tarfile.open(f"{tmp_path}/{k}.tar", "w") as tar:
            for i, name in enumerate(names):
                info = tarfile.TarInfo(name)
                body = b"" if name.endswith(("/", "empty.txt")) else bytes([i]) * (700 + i)
                info.size, info.type = len(body), tarfile.DIRTYPE if name.endswith("/") else tarfile.REGTYPE
                tar.addfile(info, io.BytesIO(body))
    df = footers.tar_members(spark, str(tmp_path), 5000)
    assert df.rdd.getNumPartitions() >= 20
    got = {(r["archive"].rsplit("/")[-1], r["member"]): bytes(r["content"]) for r in df.collect()}
    assert got == {(f"{k}.tar", n): b"" if n.endswith("empty.txt") else bytes([i]) * (700 + i) for k in range(2) for i, n in enumerate(names) if not n.endswith("/")}


def test_lines_are_numbered_by_their_blocks(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.json").write_text("".join(f'{{"id": {i}}}\n' for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = readers.manifest(spark, f"{tmp_path}/x", "id long")
        assert rows.rdd.getNumPartitions() > 3
        assert readers.indexed(rows, "n").filter("n = id").count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
