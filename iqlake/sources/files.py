"""File listings, archive inventories and manifests. Ids S02-S04, S11, S26, S28, K11, H07, H08, G15, J06 of the survey."""

from __future__ import annotations

import hashlib
import io
import tarfile
from collections.abc import Iterator, Sequence
from itertools import repeat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sha256 import Sha256
from .sinks import scratch

#: Members and declared bytes of an archive, at most.
MEMBERS, DECLARED = 64, 4 << 30
#: Bytes that are read at once.
CHUNK = 1 << 20
#: Bytes of a file that one task reads whole at most; of a larger file's range that one task digests, but for one line; of a piece of it.
WHOLE, RANGE, PIECE = 64 << 20, 256 << 20, 4 << 10
#: Endings of files that Spark's text reader would unpack, and the mark that it drops from a file's beginning.
PACKED, MARK = r"\.(gz|bz2|deflate|lz4|snappy|zst|passthrough)$", b"\xef\xbb\xbf"
#: Fixed value: member paths that may not be unpacked.
UNSAFE = r"(^/)|(^\\)|(^[A-Za-z]:)|((^|[/\\])\.\.([/\\]|$))|(.{256,})|(^$)"


def file_system(path: str):
    """(file system, path in it) of a URI by pyarrow; a plain path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def listing(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, size, modified, sha256) of files below a path. S28, K11.

    Files of up to WHOLE bytes are read whole, each by one task. Larger ones are read in splits and digested range after range, the
    digest's state going from task to task, when this is called. Two kinds can't be cut: those that end like packed files are read
    whole, and a stretch without line feeds is in one task.
    """
    read = lambda kind: spark.read.format(kind).option("pathGlobFilter", glob).option("recursiveFileLookup", recursive)
    files = read("binaryFile").load(path)
    large = (F.col("_metadata.file_size") > WHOLE) & ~F.col("_metadata.file_name").rlike(PACKED)  # known before anything is read
    size, modified = F.col("length").alias("size"), F.col("modificationTime").alias("modified")
    wide = files.where(large).select("path", size, modified, F.col("_metadata.file_path").alias("_file"))
    most = wide.agg(F.max("size")).first()[0]
    if most is None:
        return files.select("path", size, modified, F.sha2("content", 256).alias("sha256"))
    lines = read("text").option("lineSep", "\n").load(path).where(large)
    lines = lines.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("raw"))
    kept = scratch(spark, "digests")
    wide.join(_range_digests(lines, wide, most), "_file").select("path", "size", "modified", "sha256").write.parquet(kept)
    narrow = files.where(~large).select("path", size, modified, F.sha2("content", 256).alias("sha256"))
    return narrow.unionByName(spark.read.schema(narrow.schema).parquet(kept))


def _range_digests(lines: DataFrame, files: DataFrame, most: int) -> DataFrame:
    """(_file, sha256) of files (_file, size) of up to ``most`` bytes from their lines (_file, start, raw), which tasks have in order
    for each start of a split.

    Lines are kept as pieces, in folders by range. A file's state meets the pieces of the next range in a task, so a task has one
    range of a file at a time, whatever the file's size. Every line is taken with a line feed; one too many is cut off at the end.
    """
    spark, path = lines.sparkSession, scratch(lines.sparkSession, "pieces")
    piece = pa.schema([("_file", pa.string()), ("start", pa.int64()), ("k", pa.int64()), ("n", pa.int64()), ("raw", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, k, held, n = None, 0, [], 0

        def put() -> pa.RecordBatch:
            raw = b"\n".join(held) + b"\n"
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*at, k, len(raw), raw), piece, strict=True)], schema=piece)

        for batch in batches:
            if not batch.num_rows:
                continue
            names, starts, texts = (batch.column(i) for i in range(3))
            one = (names[0].as_py(), starts[0].as_py()), (names[-1].as_py(), starts[-1].as_py())  # a split's lines come in a row
            keys = repeat(one[0], len(texts)) if one[0] == one[1] else zip(names.to_pylist(), starts.to_pylist(), strict=True)
            for key, raw in zip(keys, texts.to_pylist(), strict=True):
                if held and (key != at or n >= PIECE):
                    yield put()
                    k, held, n = k + 1, [], 0
                if key != at:
                    at, k = key, 0
                held.append(raw)
                n += len(raw) + 1
        if held:
            yield put()

    cuts = lines.mapInArrow(cut, "_file string, start long, k long, n long, raw binary")
    cuts.withColumn("_range", F.expr(f"start div {RANGE}")).write.partitionBy("_range").parquet(path)
    pieces = spark.read.schema("_file string, start long, k long, n long, raw binary, _range long").parquet(path)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = size = own = None

        def put() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([size], pa.int64()), pa.array([own.state()], pa.binary())], names=["_file", "size", "raw"])

        for batch in batches:
            for file, start, n, raw in zip(*(batch.column(c).to_pylist() for c in ("_file", "start", "n", "raw")), strict=True):
                if start < 0:
                    if name is not None:
                        yield put()
                    name, size, own = file, n, Sha256(raw)
                else:
                    own.update(raw[: size - own.count])
        if name is not None:
            yield put()

    total = pieces.groupBy("_file").agg(F.sum("n").alias("total"))
    over = F.coalesce(F.col("total"), F.lit(0)) - F.col("size")
    first = lambda lead: F.lit(Sha256().update(lead).state())
    begun = F.when(over.isin(0, 1), first(b"")).when(over.isin(-len(MARK), 1 - len(MARK)), first(MARK)).otherwise(F.raise_error(F.concat(F.lit("not read as it is: "), "_file")).cast("binary"))
    states = files.select("_file", "size").join(total, "_file", "left").select("_file", "size", begun.alias("raw"))
    for r in range(most // RANGE + 1):
        heads = states.select("_file", F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("k"), F.col("size").alias("n"), "raw")
        both = heads.unionByName(pieces.where(F.col("_range") == r).drop("_range")).repartition("_file").sortWithinPartitions("_file", "start", "k")
        states = both.select("_file", "start", "n", "raw").mapInArrow(fold, "_file string, size long, raw binary")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Sha256(raw) for raw in batch.column(2).to_pylist()]
            if [d.count for d in found] != batch.column(1).to_pylist():
                raise ValueError("a file's size isn't that of its listing")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d.hexdigest() for d in found], pa.string())], names=["_file", "sha256"])

    return states.mapInArrow(finish, "_file string, sha256 string")


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, size, kind, safe) of tar archives, compressed or not, without unpacking. S02-S04."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, content in zip(f.path, f.content, strict=True):
                rows, declared = [], 0
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        declared += m.size
                        if len(rows) >= MEMBERS or declared > DECLARED:
                            raise ValueError(f"{p} has more members or bytes than allowed")
                        rows.append((p, m.name, m.size, "file" if m.isfile() else "dir" if m.isdir() else "other"))
                yield pd.DataFrame(rows, columns=["path", "member", "size", "kind"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    members = files.mapInPandas(run, "path string, member string, size long, kind string")
    return members.withColumn("safe", ~F.col("member").rlike(UNSAFE) & F.col("kind").isin("file", "dir"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, sha256, members, bytes, safe): one row per archive. S04."""
    members = archive_members(spark, path).groupBy("path").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes"), F.bool_and("safe").alias("safe"))
    return listing(spark, path).select("path", "size", "sha256").join(members, "path")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change) of files whose size or time differ between two listings, or that only one of them has. S11."""
    b = before.select("path", F.col("size").alias("_size"), F.col("modified").alias("_modified"))
    change = F.when(F.col("size").isNull(), "gone").when(F.col("_size").isNull(), "new").when((F.col("size") != F.col("_size")) | (F.col("modified") != F.col("_modified")), "changed")
    return after.select("path", "size", "modified").join(b, "path", "full_outer").select("path", change.alias("change")).where("change is not null")


def _listed(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, size, modified) of files below a path; their content isn't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def digested(files: DataFrame) -> DataFrame:
    """``files`` (path...) with sha256 of what each path holds, read piece by piece by the task that has the row: a file of any
    size, on any store that pyarrow's file systems reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(batch.schema.get_field_index("path")).to_pylist():
                digest = hashlib.sha256()
                store, at = file_system(path)
                with store.open_input_stream(at) as stream:
                    while piece := stream.read(CHUNK):
                        digest.update(piece)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "sha256"])

    return files.mapInArrow(run, T.StructType([*files.schema.fields, T.StructField("sha256", T.StringType())]))


def unread(now: DataFrame, known: DataFrame) -> DataFrame:
    """The files of a listing that ``known`` doesn't have with the same path, size and time."""
    return now.join(known.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")


def cached_digests(spark: SparkSession, path: str, known: DataFrame | None = None, glob: str = "*") -> DataFrame:
    """``listing`` that takes digests of files with the same path, size and time from ``known`` and reads only the others. H08.

    The files to read are rows like any others: they are dealt to the tasks, and no list of them is gathered.
    """
    now, key = _listed(spark, path, glob), ["path", "size", "modified"]
    if known is None:
        return digested(now)
    return now.join(known.select(*key, "sha256"), key).unionByName(digested(unread(now, known).repartition("path")))


def freeze_rows(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, size, sha256, issues) of the artifacts to freeze: a path below ``path`` that names the test split, or JSON that
    doesn't say ``"test_accessed": false``, is an issue. Paths are unique, as a listing has each file once. G15."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    is_json = F.col("path").endswith(".json")
    opened = is_json & (F.coalesce(F.get_json_object(F.col("content").cast("string"), "$.test_accessed"), F.lit("none")) != "false")
    root = path.rstrip("/").rsplit(":", 1)[-1].lstrip("/")
    below = F.lower(F.expr(f"substr(path, locate('{root}', path) + {len(root)})"))
    found = F.array(F.when(below.rlike(r"(^|[/_.-])test([/_.-]|$)"), F.lit("test_path")), F.when(opened, F.lit("test_accessed")))
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.filter(found, lambda x: x.isNotNull()).alias("issues"))


def artifacts(runs: DataFrame, listed: DataFrame, names: Sequence[str] = ("config.yml", "metrics.json", "best.pt")) -> DataFrame:
    """(run_id, one column per name) for each run: the path of its file of that name, in the folder called like the run. A file
    that is missing, or found twice, gives null. J06."""
    parts = F.split("path", "/")
    files = listed.select(F.try_element_at(parts, F.lit(-2)).alias("run_id"), F.element_at(parts, -1).alias("name"), "path").where(F.col("name").isin(*names))
    one = lambda n: F.when(F.count_if(F.col("name") == n) == 1, F.max(F.when(F.col("name") == n, F.col("path")))).alias(n)
    return runs.select("run_id").distinct().join(files.groupBy("run_id").agg(*map(one, names)), "run_id", "left")
