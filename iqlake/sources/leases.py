"""Writing a table under a lease that runs out, with tokens that fence off late writers. Ids K02, K03 of the survey."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .sinks import _file, create_once, small_text

#: Seconds that a lease holds without being renewed. Clocks of drivers should differ by much less.
SECONDS = 900.0


class LeaseLost(RuntimeError):
    """Another writer has taken the lease over."""


def _tokens(spark: SparkSession, path: str, kind: str) -> list[int]:
    """The numbers of the lease or manifest files of a table, ascending."""
    fs, folder = _file(spark, f"{path}/{kind}")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


@dataclass
class Lease:
    """The right to publish the next version of a table. ``token`` is larger than that of every lease before."""

    spark: SparkSession
    path: str
    owner: str
    token: int
    seconds: float

    @property
    def data(self) -> str:
        """The folder of this lease's version, which no other lease writes to."""
        return f"{self.path}/data/{self.token}"

    def held(self) -> bool:
        """Whether nobody has taken the lease over."""
        return _tokens(self.spark, self.path, "lease")[-1] == self.token

    def publish(self, rows: DataFrame) -> str:
        """Write ``rows`` as this version, then the manifest that makes readers see it. Raises LeaseLost, before or after the data
        is written, if the lease has been taken over; the manifest comes last, so half a version is never seen."""
        for step in ("write", "manifest"):
            if not self.held():
                raise LeaseLost(f"{self.path}: lease {self.token} of {self.owner} was taken over")
            if step == "write":
                rows.write.mode("errorifexists").parquet(self.data)
        create_once(self.spark, f"{self.path}/manifest/{self.token}.json", json.dumps({"owner": self.owner, "token": self.token, "at": time.time()}))
        return self.data

    def release(self) -> None:
        """Let the next writer in at once."""
        if self.held():
            fs, p = _file(self.spark, f"{self.path}/lease/{self.token}.free")
            fs.create(p, True).close()


def acquire(spark: SparkSession, path: str, owner: str | None = None, seconds: float = SECONDS) -> Lease:
    """Take the lease of the table at ``path``; raises FileExistsError while another one holds.

    A lease is a file named after its token that only one writer can create. A writer that died keeps others out until its lease
    runs out; whoever creates the next token then has it, and the old one can't publish any more.
    """
    owner = owner or uuid.uuid4().hex
    known = _tokens(spark, path, "lease")
    if known:
        last = known[-1]
        record = json.loads(small_text(spark, f"{path}/lease/{last}.json") or '{"until": null}')
        fs, free = _file(spark, f"{path}/lease/{last}.free")
        # a record that isn't written yet belongs to a writer who has only just begun
        until = record["until"] if record["until"] is not None else fs.getFileStatus(_file(spark, f"{path}/lease/{last}.json")[1]).getModificationTime() / 1000 + seconds
        if time.time() < until and not fs.exists(free):
            raise FileExistsError(f"{path} is held by {record.get('owner')} until {until}")
    token = known[-1] + 1 if known else 1
    create_once(spark, f"{path}/lease/{token}.json", json.dumps({"owner": owner, "until": time.time() + seconds}))
    return Lease(spark, path, owner, token, seconds)


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The latest version that has a manifest, None if there is none."""
    known = _tokens(spark, path, "manifest")
    return spark.read.parquet(f"{path}/data/{known[-1]}") if known else None
