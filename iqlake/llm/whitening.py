"""Whitening of embeddings: partitions' singular value decompositions, merged level by level without losing a dimension."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: An entry c becomes the whole number floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components given at most; partial decompositions that one task merges; rows that are decomposed at once.
COMPONENTS, FAN_IN, ROWS = 16, 8, 4096
#: A model of at most so many bytes is sent to all tasks, a larger one is joined.
BROADCAST_BYTES = 8 << 20
#: Copies of a model among which the rows of one length are dealt where it is joined.
SALTS = 64
#: Numbers beyond this can't be told apart in a double, so entries are held at it.
LARGEST = 1 << 53
_SUMMARY = "dims int, part long, n long, total array<decimal(38,0)>, mean array<double>, s array<double>, v array<double>"
_MODEL = "dims int, n long, total array<decimal(38,0)>, mean array<double>, values array<double>, vectors array<double>, trace double"


class Part:
    """Rows of one width by their number, sums, mean, and the singular values and right vectors of the centred rows.

    sums are exact Python integers; ``mean`` is that of the rows without SHIFT.
    """

    def __init__(self, n: int, total: list[int], mean: np.ndarray, s: np.ndarray, v: np.ndarray):
        self.n, self.total, self.mean, self.s, self.v = n, total, mean, s, v

    @classmethod
    def of(cls, x: np.ndarray) -> Part:
        """The decomposition of whole numbers, one row per vector."""
        wide = np.abs(x).max(initial=0) > (1 << 62) // max(1, len(x))
        total = x.astype(object).sum(0).tolist() if wide else x.sum(0).tolist()
        mean = np.array([t / len(x) for t in total])
        _, s, v = np.linalg.svd(x - mean, full_matrices=False)
        return cls(len(x), total, mean, s, v)

    def merge(self, other: Part) -> Part:
        """Both parts' rows: what they hold in their vectors' coordinates, and a row for the distance of their means.

        Nothing is cut off, so as many dimensions as there can be are kept.
        """
        n = self.n + other.n
        apart = np.sqrt(self.n * (other.n / n)) * (self.mean - other.mean)
        _, s, v = np.linalg.svd(np.vstack([self.s[:, None] * self.v, other.s[:, None] * other.v, apart]), full_matrices=False)
        total = [a + b for a, b in zip(self.total, other.total, strict=True)]
        return Part(n, total, self.mean + (other.mean - self.mean) * (other.n / n), s, v)

    def row(self) -> dict:
        return {"n": self.n, "total": self.total, "mean": self.mean.tolist(), "s": self.s.tolist(), "v": self.v.ravel().tolist()}

    @classmethod
    def from_row(cls, r) -> Part:
        return cls(int(r.n), [int(t) for t in r.total], np.array(r.mean), np.array(r.s), np.array(r.v).reshape(len(r.s), -1))


def merged(parts: Iterable[Part]) -> Part:
    """Parts merged two by two, so that the number of merges a row goes through is logarithmic."""
    parts = list(parts)
    while len(parts) > 1:
        parts = [a.merge(b) for a, b in zip(parts[::2], parts[1::2], strict=False)] + ([parts[-1]] if len(parts) % 2 else [])
    return parts[0]


def usable(vector: str = "embedding") -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, finite) & (F.size(vector) > 0), F.lit(False))


def whole(vector: str = "embedding") -> Column:
    """The whole numbers of a vector without SHIFT, which no centred value depends on."""
    held = lambda x: F.least(F.greatest(x.cast("double") * F.lit(float(SCALE)), F.lit(-float(LARGEST))), F.lit(float(LARGEST)))
    return F.transform(vector, lambda x: F.floor(held(x)))


def _matrices(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) per width of the vectors in a batch."""
    lists = batch.column(column)
    widths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        yield at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), int(w))


def summaries(vectors: DataFrame) -> DataFrame:
    """One row per width and partition of ``vectors`` (x array<long>): its decomposition, built up from ROWS rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, Part]]] = {}
        for batch in batches:
            for _, x in _matrices(batch):
                for k in range(0, len(x), ROWS):
                    # like a binary counter: parts of about the same number of rows merge
                    level, part, stack = 0, Part.of(x[k : k + ROWS]), held.setdefault(x.shape[1], [])
                    while stack and stack[-1][0] == level:
                        part, level = stack.pop()[1].merge(part), level + 1
                    stack.append((level, part))
        place = TaskContext.get().partitionId()
        for dims, stack in held.items():
            yield _rows([{"dims": dims, "part": place} | merged(p for _, p in stack).row()])

    return vectors.select("x").mapInArrow(run, _SUMMARY)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    wide, reals = pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64())
    types = {"dims": pa.int32(), "part": pa.int64(), "n": pa.int64(), "total": wide, "mean": reals, "s": reals, "v": reals}
    for r in rows:
        r["total"] = [Decimal(t) for t in r["total"]]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(types.items())))


def fit(vectors: DataFrame) -> DataFrame:
    """(dims, n, total, mean, values, vectors, trace), one row per width of the different vectors ``x`` in ``vectors``.

    The partitions' decompositions are merged FAN_IN at a time, level by level, each level kept in the shared folder; a task
    never holds more than FAN_IN square matrices of the width. ``values`` are all eigenvalues of the covariance with divisor n,
    falling, ``vectors`` the unit eigenvectors row by row.
    """

    def merge(frames: pd.DataFrame) -> pd.DataFrame:
        part = merged(Part.from_row(r) for r in frames.sort_values("part").itertuples())
        row = {"dims": int(frames.dims.iloc[0]), "part": int(frames.part.min()) // FAN_IN} | part.row()
        row["total"] = [Decimal(t) for t in row["total"]]
        return pd.DataFrame([row])

    def model(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples():
                p = Part.from_row(r)
                # centred rows of fewer than dims vectors leave directions without variance
                values = np.r_[p.s**2 / p.n, np.zeros(max(0, r.dims - len(p.s)))][: r.dims]
                out.append((r.dims, r.n, list(r.total), list(r.mean), values.tolist(), p.v.ravel().tolist(), float(np.sum(p.s**2) / p.n)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _MODEL.split(", ")])

    level = stored(summaries(vectors), "svd")
    while (most := level.agg(F.max("part")).first()[0]) is not None and most > 0:
        level = stored(level.groupBy("dims", F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, _SUMMARY), "svd")
    return stored(level.mapInPandas(model, _MODEL), "whitening")


def _project(x: np.ndarray, m, k: int) -> np.ndarray:
    """Rows in the first k components, each over the root of its eigenvalue; NaN where that is nothing but rounding."""
    values = np.array(m["values"])[:k]
    v = np.array(m["vectors"]).reshape(-1, m["dims"])[:k]
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.full((len(x), len(values)), np.nan)
        real = varies(np.array(m["values"]))[:k]
        out[:, real] = ((x - np.array(m["mean"])) @ v[: len(real)][real[: len(v)]].T) / np.sqrt(values[real])
    return out


def varies(values: np.ndarray) -> np.ndarray:
    """Which eigenvalues are more than rounding errors of the largest one."""
    return values > (values.max(initial=0) * len(values) * np.finfo(float).eps) if len(values) else np.zeros(0, bool)


def _deviation(x: np.ndarray, n: int, total: list[int]) -> list[int]:
    """Exact sums of (n * x - S)^2 over the dimensions."""
    most = max(n * int(np.abs(x).max(initial=0)), 1) + max((abs(t) for t in total), default=0)
    if most * most * max(1, x.shape[1]) < 1 << 63:
        d = x * n - np.array(total, np.int64)
        return (d * d).sum(1).tolist()
    d = x.astype(object) * n - np.array(total, object)
    return (d * d).sum(1).tolist()


def _with_model(rows: DataFrame, model: DataFrame) -> tuple[DataFrame, dict[int, dict] | None]:
    """``rows`` (x, dims...) and the models by width. If the models are too large for all tasks, None, and each row has its own."""
    size = model.agg(F.coalesce(F.sum(8 * (F.size("vectors") + 4 * F.size("mean"))), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return rows, {r.dims: r.asDict() for r in model.collect()}
    salted = model.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("x"), F.lit(SALTS)).cast("int")).join(salted, ["dims", "_salt"]).drop("_salt"), None


def _fitted(batch: pa.RecordBatch, models: dict[int, dict] | None) -> Iterator[tuple[np.ndarray, np.ndarray, dict]]:
    """(places, matrix, model) per width of the vectors in a batch."""
    for at, x in _matrices(batch):
        yield at, x, models[x.shape[1]] if models is not None else batch.slice(int(at[0]), 1).to_pylist()[0]


def _first(model: DataFrame, k: int) -> DataFrame:
    """The model with its first k components only, which is all that a projection reads."""
    return model.withColumn("vectors", F.slice("vectors", F.lit(1), F.col("dims") * k))


def identity_errors(vectors: DataFrame, model: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """(dims, identity_error): how far the covariance of the whitened fit list is from the identity, entry by entry.

    Per partition the number, means and centred products of k whitened columns, merged FAN_IN at a time like the model.
    """
    schema = "dims int, part long, n long, mean array<double>, m2 array<double>"

    def joined(a: tuple, b: tuple) -> tuple:
        n = a[0] + b[0]
        d = b[1] - a[1]
        return n, a[1] + d * (b[0] / n), a[2] + b[2] + np.outer(d, d) * (a[0] * (b[0] / n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            for _, x, m in _fitted(batch, models):
                w = _project(x, m, k)
                w = w[:, varies(np.array(m["values"]))[:k]]
                mean = w.mean(0)
                mine = (len(w), mean, (w - mean).T @ (w - mean))
                held[m["dims"]] = joined(held[m["dims"]], mine) if m["dims"] in held else mine
        place = TaskContext.get().partitionId()
        rows = [{"dims": d, "part": place, "n": n, "mean": mean.tolist(), "m2": m2.ravel().tolist()} for d, (n, mean, m2) in held.items()]
        reals = pa.list_(pa.float64())
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema({"dims": pa.int32(), "part": pa.int64(), "n": pa.int64(), "mean": reals, "m2": reals}))

    def merge(f: pd.DataFrame) -> pd.DataFrame:
        total = None
        for r in f.sort_values("part").itertuples():
            mine = (int(r.n), np.array(r.mean), np.array(r.m2).reshape(len(r.mean), -1))
            total = mine if total is None else joined(total, mine)
        return pd.DataFrame([{"dims": int(f.dims.iloc[0]), "part": int(f.part.min()) // FAN_IN, "n": total[0], "mean": total[1].tolist(), "m2": total[2].ravel().tolist()}])

    @F.pandas_udf("double")
    def error(n: pd.Series, m2: pd.Series) -> pd.Series:
        side = [round(len(m) ** 0.5) for m in m2]
        return pd.Series([float(np.abs(np.array(m).reshape(s, s) / k - np.eye(s)).max(initial=0)) for k, m, s in zip(n, m2, side, strict=True)])

    fitted, models = _with_model(vectors.select("dims", "x"), _first(model, k))
    level = stored(fitted.mapInArrow(run, schema), "cov")
    while (most := level.agg(F.max("part")).first()[0]) is not None and most > 0:
        level = stored(level.groupBy("dims", F.floor(F.col("part") / FAN_IN)).applyInPandas(merge, schema), "cov")
    return level.select("dims", error("n", "m2").alias("identity_error"))


def whiten(table: DataFrame, k: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Whiten all vectors of ``table``; one row per vector and component.

    Entries become whole numbers x = floor(64 * c) + 1000000. The covariance, with divisor n, is that of the fit list, which
    holds each different vector once. Components are numbered from 1 by falling eigenvalue, min(k, width) of them, with one sign
    for all rows.

    Returns (key, component, n, deviation, whitened, explained, identity_error): n vectors in the fit list; deviation the exact sum
    over the dimensions of (n*x - S)^2, S being the list's sums, as decimal(38,0); whitened the vector's distance from the mean
    along the component over the root of its eigenvalue; explained the eigenvalue's share of all; identity_error the largest
    absolute entry of the whitened list's covariance minus the identity.

    Rows whose vector is null, empty or holds null or non-finite entries are left out. Vectors of another width are a fit list of
    their own. Components whose eigenvalue is zero but for rounding (constant dimensions, fewer different vectors than
    dimensions) have a null ``whitened`` and don't count for identity_error; where no dimension varies, ``explained`` is 0.
    Repeated rows and null keys are rows like others; entries are held at 2^53 either way. An empty table gives no
    rows; other columns are not looked at.
    """
    rows = table.where(usable(vector)).select(F.col(key).alias("key"), whole(vector).alias("x")).withColumn("dims", F.size("x"))
    # copies are put together in each task before the shuffle
    fitted = stored(rows.select("x", "dims").distinct(), "vectors")
    model = fit(fitted)
    errors = identity_errors(fitted, model, k)
    ready = stored(_first(model, k).join(errors, "dims", "left"), "whitening")
    key_type = rows.schema["key"].dataType
    schema = f"key {key_type.simpleString()}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x, m in _fitted(batch, models):
                n, w = int(m["n"]), _project(x, m, k)
                c, far = w.shape[1], [Decimal(d) for d in _deviation(x, n, [int(t) for t in m["total"]])]
                share = np.array(m["values"])[:c] / m["trace"] if m["trace"] > 0 else np.zeros(c)
                each = pa.array(np.repeat(np.arange(len(x)), c))
                columns = [
                    batch.column("key").take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n)),
                    pa.array(far, pa.decimal128(38, 0)).take(each), pa.array(w.ravel(), from_pandas=True), pa.array(np.tile(share, len(x))), pa.array(np.full(len(each), float(m["identity_error"]))),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    wanted, models = _with_model(rows, ready)
    return wanted.mapInArrow(run, schema).withColumnRenamed("key", key)
