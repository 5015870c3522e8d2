"""All pairs of near-duplicate windows of a table of any size, by their spectra. Ids H09, J08 of the survey."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import scratch
from .dedup import float_digest

#: Least score of a pair; windows of a cell that are compared at once; centres of a level at most; levels at most.
SCORE, CELL, CENTRES, LEVELS = 0.999, 8192, 1024, 4
#: Room for rounding in bounds that decide what is compared; scores themselves have none.
ROOM = 1e-9


def _spectra(i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit spectra of complex windows (rows), and the magnitudes of these."""
    s = np.fft.fft(i.astype(np.float64) + 1j * q, axis=1)
    s /= np.linalg.norm(s, axis=1)[:, None]
    return s, np.abs(s)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The largest circular correlation of windows by their unit spectra, row by row."""
    return np.minimum(np.abs(np.fft.ifft(a * np.conj(b), axis=1)).max(1) * a.shape[1], 1.0)


def _stacked(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def visits(spectra: np.ndarray, home: np.ndarray, centres: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, home): the cells that magnitude spectra belong to, by their nearest centre, and visit.

    What lies within the radius of a row and has another centre lies beyond the plane half way between the two centres, so a row visits
    the cells whose planes are within the radius of it. If it isn't a visitor itself, only those after its own cell by number, as
    windows there don't visit it then.
    """
    far = np.maximum((spectra * spectra).sum(1)[:, None] - 2 * spectra @ centres.T + (centres * centres).sum(1), 0)
    own = far.argmin(1)
    apart = np.linalg.norm(centres[:, None] - centres[None], axis=2) if len(centres) <= 64 else np.sqrt(np.maximum((centres * centres).sum(1)[:, None] - 2 * centres @ centres.T + (centres * centres).sum(1), 0))
    gap = far - far[np.arange(len(far)), own][:, None]
    near = gap <= 2 * apart[own] * radius + ROOM
    later = np.arange(len(centres))[None] > own[:, None]
    near &= later | ~home[:, None]
    near[np.arange(len(far)), own] = False
    row, cell = np.nonzero(near)
    return np.concatenate([np.arange(len(own)), row]), np.concatenate([own, cell]), np.concatenate([home, np.zeros(len(row), bool)])


def thinned(centres: np.ndarray, apart: float) -> np.ndarray:
    """Centres of which no two are closer than ``apart``: those of one crowd would all be visited by all of it."""
    kept = centres[:1]
    for c in centres[1:]:
        if ((kept - c) ** 2).sum(1).min() >= apart * apart:
            kept = np.vstack([kept, c])
    return kept


def _placed(centres: np.ndarray, radius: float):
    """A function that deals rows (key, i, q, home, cell) to the cells of ``centres``, each within the cell that it was in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                _, m = _spectra(_stacked(batch, "i"), _stacked(batch, "q"))
                at, cell, home = visits(m, batch.column("home").to_numpy(zero_copy_only=False), centres, radius)
                old = batch.column("cell").to_numpy(zero_copy_only=False).view(np.uint64)[at]
                new = (old * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) ^ pd.util.hash_array(cell.astype(np.uint64))
                columns = [batch.column(n).take(pa.array(at)) for n in ("key", "i", "q")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(home), pa.array(new.view(np.int64))], names=["key", "i", "q", "home", "cell"])

    return run


def _compared(least: float):
    """A function of one group of rows (key, i, q, home, host, guest): the pairs of a guest and a host with a score of ``least`` or more.

    A guest that is at home in the cell, as all hosts are, meets hosts of larger key only.
    """

    def run(table: pa.Table) -> pa.Table:
        get = lambda n: table.column(n).to_numpy()
        flat = lambda n: table.column(n).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)
        key, home, host, guest = get("key"), get("home"), np.flatnonzero(get("host")), np.flatnonzero(get("guest"))
        found: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(host) and len(guest):
            s, m = _spectra(flat("i"), flat("q"))
            for k in range(0, len(guest), 512):
                few = guest[k : k + 512]
                near = m[few] @ m[host].T >= least - ROOM
                x, y = np.nonzero(near & (~home[few][:, None] | (key[few][:, None] < key[host][None])))
                x, y = few[x], host[y]
                score = scores(s[x], s[y])
                ok = score >= least
                x, y = key[x[ok]], key[y[ok]]
                found.append((np.minimum(x, y), np.maximum(x, y), score[ok]))
        return pa.table(dict(zip(("left", "right", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return run


def _kept(rows: DataFrame, name: str) -> DataFrame:
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def classes(rows: DataFrame, key: str = "vec_id") -> DataFrame:
    """(key, representative): windows that are equal bit for bit share the smallest key among them."""
    d = rows.select(F.col(key), float_digest("i", "q").alias("_d"))
    first = d.groupBy("_d").agg(F.min(key).alias("representative"))
    return d.join(first, "_d").select(key, "representative")


def near_pairs(rows: DataFrame, key: str = "vec_id", least: float = SCORE, cell: int = CELL) -> DataFrame:
    """(left, right, score) of all pairs of different windows whose largest circular correlation is ``least`` or more.

    The correlation of two windows is at most the cosine of their magnitude spectra, which neither shifts, gains nor phases
    change. So a pair's spectra are within a radius that ``least`` gives. Some windows' spectra are centres; each window belongs to
    the cell of its nearest centre and visits those that the radius reaches into. Cells of over ``cell`` windows are dealt to the
    cells of other centres, level by level; what is still too large then is compared in blocks. Scores are computed from the windows
    alone, so no pair is lost and none is added. This is for scores near 1: at lower ones the radius is as wide as the spectra
    are apart, and all that is left is comparing blocks.

    Copies (windows equal bit for bit) are compared once, by their smallest key; ``classes`` tells who they are. Null, empty or
    zero windows, or those with null or non-finite values, are left out, and windows of different lengths make no pair. Keys are
    whole numbers and unique.
    """
    from ..functions import arrays as A

    ok = (F.size("i") == F.size("q")) & (F.size("i") > 0) & A.all_finite(F.col("i")) & A.all_finite(F.col("q")) & ~A.all_zero(F.col("i"), F.col("q"))
    real = rows.where(F.coalesce(ok, F.lit(False))).select(F.col(key).cast("long").alias("key"), "i", "q")
    first = classes(real, "key").where("key = representative").select("key")
    windows = _kept(real.join(first, "key").select("key", "i", "q"), "windows")
    lengths = [r.n for r in windows.select(F.size("i").alias("n")).distinct().collect()]
    found = [_pairs(windows.where(F.size("i") == n), least, cell) for n in sorted(lengths)]
    empty = rows.sparkSession.createDataFrame([], "left long, right long, score double")
    for f in found:
        empty = empty.unionByName(f)
    return empty


def _pairs(windows: DataFrame, least: float, most: int) -> DataFrame:
    """``near_pairs`` of different windows of one length."""
    radius = math.sqrt(2 * max(0.0, 1 - least) + 4 * ROOM)
    kind = windows.schema["i"].dataType.simpleString()
    schema, pair = f"key long, i {kind}, q {kind}, home boolean, cell long", "left long, right long, score double"
    left = windows.select("key", "i", "q", F.lit(True).alias("home"), F.lit(0).cast("long").alias("cell"))
    rows, done = windows.count(), []
    for level in range(LEVELS if rows > most else 0):
        few = left.where("home").orderBy(F.xxhash64("key", F.lit(level))).limit(min(CENTRES, max(2, 4 * rows // most))).select("i", "q").toArrow().combine_chunks()
        if not few.num_rows:
            break
        centres = thinned(_spectra(_stacked(few.to_batches()[0], "i"), _stacked(few.to_batches()[0], "q"))[1], 4 * radius)
        dealt = _kept(left.mapInArrow(_placed(centres, radius), schema), "cells")
        sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"), F.count_if("home").alias("_h")).where("_h > 0 and _n > 1")
        sizes = _kept(sizes.select("cell", "_n", (F.col("_n") > most).alias("_large")), "sizes")
        large = sizes.where("_large").agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        if large > 2 * rows:  # the radius is too wide for these centres: cells only repeat their windows
            break
        small = dealt.join(sizes.where("not _large").select("cell"), "cell").select("*", F.lit(True).alias("guest"), F.col("home").alias("host"))
        done.append(small.groupBy("cell").applyInArrow(_compared(least), pair))
        left, rows = dealt.join(sizes.where("_large").select("cell"), "cell").select("key", "i", "q", "home", "cell"), large
        if not large:
            break
    if rows:
        done.append(_blocks(left, most).groupBy("cell", "_h", "_g").applyInArrow(_compared(least), pair))
    out = done[0] if done else windows.sparkSession.createDataFrame([], pair)
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _blocks(left: DataFrame, most: int) -> DataFrame:
    """Cells of any size in blocks of hosts and blocks of guests, each of which meets each of the other kind in a group."""
    sizes = left.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / (most // 2)).cast("int").alias("_b"))
    dealt = left.join(sizes, "cell").withColumn("_own", F.pmod(F.xxhash64("key"), F.col("_b")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("_b") - 1))
    columns = ["key", "i", "q", "home", "cell", "_h", "_g", "host", "guest"]
    hosts = dealt.where("home").select("*", F.col("_own").alias("_h"), others.alias("_g"), F.lit(True).alias("host"), F.lit(False).alias("guest"))
    guests = dealt.select("*", others.alias("_h"), F.col("_own").alias("_g"), F.lit(False).alias("host"), F.lit(True).alias("guest"))
    return hosts.select(columns).unionByName(guests.select(columns))
