"""Python data sources whose partitions come from a file's own directory of contents: Parquet row groups and tar headers.

The planner reads footers and headers only; a task opens its file at its own place, so a lost task reads its part again and no more. Paths are
local or mounted ones, or any address that ``pyarrow.fs`` knows.
"""

from __future__ import annotations

import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from lexloom.session import prepare

#: Spark's bound on a value.
MOST_BYTES = (1 << 31) - 16


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str, endings: tuple[str, ...]) -> list[str]:
    """Files below a path in order of name; hidden ones and those with other endings do not count."""
    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [at]
    found = store.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(i.path for i in found if i.type == fs.FileType.File and i.path.endswith(endings) and not any(part.startswith(("_", ".")) for part in i.path[len(at) :].split("/")))


@dataclass
class Groups(InputPartition):
    """Row groups of one file; ``first``: the number of rows in front of each; every ``step``-th row from ``start`` on counts."""

    file: str
    groups: tuple[int, ...]
    first: tuple[int, ...]
    start: int = 0
    step: int = 1


class RowGroupReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.path, self.schema = options["path"], to_arrow_schema(schema)
        self.chunk = int(options.get("chunkBytes", 64 << 20))
        self.rank, self.ranks = int(options.get("rank", 0)), int(options.get("ranks", 1))
        if not 0 <= self.rank < self.ranks:
            raise ValueError("rank out of range")

    def partitions(self) -> list[Groups]:
        """A rank's share: whole files if there are at least as many as ranks, else row groups if there are, else every ``ranks``-th row."""
        store, files = _store(self.path)[0], _files(self.path, (".parquet",))
        by_file = len(files) >= self.ranks
        groups, row = [], 0
        for name in files[self.rank :: self.ranks] if by_file else files:
            meta = pq.ParquetFile(store.open_input_file(name)).metadata
            for g in range(meta.num_row_groups):
                groups.append((name, g, row, meta.row_group(g).total_byte_size))
                row += meta.row_group(g).num_rows
        by_row = not by_file and len(groups) < self.ranks
        if not by_file and not by_row:
            groups = groups[self.rank :: self.ranks]
        chunks: list[list] = []
        size = 0
        for group in groups:
            if not chunks or chunks[-1][-1][0] != group[0] or size + group[3] > self.chunk:
                chunks.append([])
                size = 0
            chunks[-1].append(group)
            size += group[3]
        step, start = (self.ranks, self.rank) if by_row else (1, 0)
        return [Groups(c[0][0], tuple(g for _, g, _, _ in c), tuple(r for _, _, r, _ in c), start, step) for c in chunks]

    def read(self, partition: Groups) -> Iterator[pa.RecordBatch]:
        file = pq.ParquetFile(_store(self.path)[0].open_input_file(partition.file))
        for group, row in zip(partition.groups, partition.first, strict=True):
            for batch in file.iter_batches(batch_size=4096, row_groups=[group], columns=self.schema.names):
                mine = pa.array(range((partition.start - row) % partition.step, batch.num_rows, partition.step), pa.int64())
                row += batch.num_rows
                part = batch.select(self.schema.names) if partition.step == 1 else batch.select(self.schema.names).take(mine)
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(part.columns, self.schema, strict=True)], schema=self.schema)


class RowGroups(DataSource):
    """Columns of Parquet files, a task for each run of row groups of at most ``chunkBytes`` (uncompressed), for one of ``ranks`` readers."""

    @classmethod
    def name(cls) -> str:
        return "row_groups"

    def schema(self):
        store, files = _store(self.options["path"])[0], _files(self.options["path"], (".parquet",))
        if not files:
            raise FileNotFoundError(f"no Parquet file in {self.options['path']}")
        found = pq.ParquetFile(store.open_input_file(files[0])).schema_arrow
        wanted = [c for c in self.options.get("columns", "").split(",") if c] or found.names
        return from_arrow_schema(pa.schema([found.field(c) for c in wanted]), prefer_timestamp_ntz=True)

    def reader(self, schema) -> RowGroupReader:
        return RowGroupReader(self.options, schema)


def row_groups(spark: SparkSession, path: str, columns: list[str] | None = None, chunk_bytes: int = 64 << 20, rank: int = 0, ranks: int = 1) -> DataFrame:
    """Rank ``rank``'s share of the rows of ``path``; the shares of all ranks are complete and disjoint."""
    prepare(spark).dataSource.register(RowGroups)
    return spark.read.format("row_groups").option("columns", ",".join(columns or [])).option("chunkBytes", chunk_bytes).option("rank", rank).option("ranks", ranks).load(path)


@dataclass
class Stretch(InputPartition):
    """Members of an archive whose headers lie from ``start`` on and before ``end``."""

    file: str
    start: int
    end: int


class TarReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.chunk = options["path"], int(options.get("chunkBytes", 64 << 20))

    def partitions(self) -> list[Stretch]:
        store, out = _store(self.path)[0], []
        for name in _files(self.path, (".tar",)):
            start, last = None, 0
            with store.open_input_file(name) as raw, tarfile.open(fileobj=raw, mode="r:") as tar:
                for m in tar:
                    tar.members = []  # they are not kept
                    if start is not None and m.offset_data + m.size - start > self.chunk:
                        out.append(Stretch(name, start, m.offset))
                        start = None
                    start, last = m.offset if start is None else start, m.offset_data + m.size
            if start is not None:
                out.append(Stretch(name, start, max(last, start + 1)))
        return out

    def read(self, partition: Stretch) -> Iterator[tuple[str, str, bytes]]:
        with _store(self.path)[0].open_input_file(partition.file) as raw:
            raw.seek(partition.start)
            with tarfile.open(fileobj=raw, mode="r:") as tar:
                for m in tar:
                    tar.members = []
                    if m.offset >= partition.end:
                        break
                    if m.isfile():
                        if m.size > MOST_BYTES:
                            raise ValueError(f"{partition.file}, {m.name}: {m.size} bytes are more than a row holds")
                        yield partition.file, m.name, tar.extractfile(m).read()


class TarMembers(DataSource):
    """Files in uncompressed tar archives, a task for each run of members of at most ``chunkBytes``."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "archive string, member string, content binary"

    def reader(self, schema) -> TarReader:
        return TarReader(self.options)


def tar_members(spark: SparkSession, path: str, chunk_bytes: int = 64 << 20) -> DataFrame:
    """archive, member, content of every file in the tar archives of ``path``, whatever an archive's size."""
    prepare(spark).dataSource.register(TarMembers)
    return spark.read.format("tar_members").option("chunkBytes", chunk_bytes).load(path)
