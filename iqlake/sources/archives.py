"""Tar archives as a data source: read member by member as a stream, written by all tasks at once. Ids S02-S04 of the survey."""

from __future__ import annotations

import hashlib
import io
import tarfile
import uuid
from collections.abc import Iterator
from fnmatch import fnmatch

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from .files import CHUNK, DECLARED, MEMBERS, UNSAFE, file_system

SCHEMA = "path string, member string, size long, kind string, sha256 string"
#: Bytes of archives in a partition at most, but for a single larger one; bytes that opening another archive counts as.
PARTITION, OPENING = 8 << 20, 64 << 10


class _Archives(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    """Small archives share a partition, as many as make PARTITION bytes or an even share of all. Equal-to, in and starts-with
    filters on ``path`` choose archives, those on ``member`` members."""

    def __init__(self, options: dict):  # keys in lower case
        self.root, self.glob = options["path"], options.get("pathglobfilter", "*")
        self.members, self.declared = int(options.get("members", MEMBERS)), int(options.get("declared", DECLARED))
        self.digests = options.get("digests", "true").lower() == "true"
        self.most, self.parallelism = int(options.get("partitionbytes", PARTITION)), int(options.get("parallelism", 1))
        self.wanted: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute in (("path",), ("member",)):
                self.wanted.append(f)
            else:
                yield f

    def _passes(self, column: str, value: str) -> bool:
        for f in self.wanted:
            if f.attribute == (column,):
                ok = value.startswith(f.value) if isinstance(f, StringStartsWith) else value in f.value if isinstance(f, In) else value == f.value
                if not ok:
                    return False
        return True

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = file_system(self.root)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        prefix = "file:" if isinstance(store, fs.LocalFileSystem) else f"{self.root.split('://')[0]}://"
        named = ((prefix + f.path, f.size + OPENING) for f in found if f.is_file and fnmatch(f.base_name, self.glob) and not f.base_name.startswith(("_", ".")))
        sizes = sorted((p, n) for p, n in named if self._passes("path", p))
        most, room, parts = min(self.most, sum(n for _, n in sizes) // self.parallelism), 0, []
        for p, n in sizes:
            if n > room:
                parts.append(_Archives([]))
                room = most
            parts[-1].paths.append(p)
            room -= n
        return parts or [_Archives([])]

    def read(self, partition: _Archives) -> Iterator[tuple]:
        for path in partition.paths:
            yield from self._read(path)

    def _read(self, name: str) -> Iterator[tuple]:
        store, path = file_system(name)
        n = declared = 0
        with store.open_input_stream(path, buffer_size=CHUNK) as stream, tarfile.open(fileobj=stream, mode="r|*") as tar:
            for m in tar:
                n, declared = n + 1, declared + m.size
                if n > self.members or declared > self.declared:
                    raise ValueError(f"{name} has more members or bytes than allowed")
                if not self._passes("member", m.name):
                    continue
                digest = None
                if m.isfile() and self.digests:
                    sha, body = hashlib.sha256(), tar.extractfile(m)
                    while piece := body.read(CHUNK):
                        sha.update(piece)
                    digest = sha.hexdigest()
                yield name, m.name, m.size, "file" if m.isfile() else "dir" if m.isdir() else "other", digest


class TarSource(DataSource):
    """``tar_members``: (path, member, size, kind, sha256) of the members of all archives below ``path``, compressed or not.

    Options: path, pathGlobFilter, members and declared (limits per archive, beyond which it raises), digests (false: sha256 is null and
    content is skipped), partitionBytes (of archives at most that share a partition), parallelism (partitions at least, if there
    are archives enough). An archive is read from its beginning to its end, CHUNK bytes at a time, whatever its size.
    """

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def tar_members(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The source's rows with ``safe``: whether the member may be unpacked, by its path and kind. S02, S03."""
    spark.dataSource.register(TarSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options = {"parallelism": spark.sparkContext.defaultParallelism, **options}
    rows = spark.read.format("tar_members").options(path=path, **{k: str(v) for k, v in options.items()}).load()
    return rows.withColumn("safe", ~F.col("member").rlike(UNSAFE) & F.col("kind").isin("file", "dir"))


def archive_inventory(members: DataFrame) -> DataFrame:
    """(path, members, bytes, safe): one row per archive. S04."""
    return members.groupBy("path").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes"), F.bool_and("safe").alias("safe"))


def write_archives(rows: DataFrame, path: str, members: int = MEMBERS, compression: str = "bz2") -> DataFrame:
    """Write ``rows`` (member, content) to tar archives of at most ``members`` members; returns (path, members).

    Each task writes its own; an archive gets its name once it is whole, so readers see no half of one, and what a lost task
    wrote before keeps a name that readers pass over. The result is kept beside the archives: reading it again writes nothing.
    """
    store, root = file_system(path)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(path)
        done: list[tuple[str, int]] = []
        part: list[tuple[str, bytes]] = []

        def put() -> None:
            name = f"{uuid.uuid4().hex}.tar.{compression}"
            with store.open_output_stream(f"{root}/.{name}") as out, tarfile.open(fileobj=out, mode=f"w|{compression}") as tar:
                for member, content in part:
                    info = tarfile.TarInfo(member)
                    info.size = len(content)
                    tar.addfile(info, io.BytesIO(content))
            done.append((name, len(part)))
            part.clear()

        for batch in batches:
            for member, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part.append((member, content or b""))
                if len(part) == members:
                    put()
        if part:
            put()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], names=["path", "members"])

    listed = f"{path}/_written"
    rows.select(F.col("member"), F.col("content").cast("binary")).mapInArrow(run, "path string, members long").write.parquet(listed)
    written = rows.sparkSession.read.schema("path string, members long").parquet(listed)

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(path)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if store.get_file_info(f"{root}/.{name}").is_file:  # else another attempt has done it
                    store.move(f"{root}/.{name}", f"{root}/{name}")
            yield batch

    written.mapInArrow(rename, "path string, members long").write.format("noop").mode("overwrite").save()
    return written
