"""Near-duplicate vectors by an inverted multi-index: two codebooks span a grid of cells, and queries visit the nearest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, spanning, stored

#: Least cosine of a link; share of the linked pairs whose cell the traversal has to reach.
COSINE, RECALL = 0.98, 0.99
#: Vectors, and components of them, that the codebooks are fitted on at most; entries of a codebook at most.
SAMPLE, VALUES, LARGEST = 20_000, 2_000_000, 256
#: Up to so many cells, all are visited; vectors that recall is measured with, each held against all rows.
FEW, PROBES = 16, 200
#: Rows of a cell, indexed or visiting, that one task compares at most.
BLOCK = 4096
_SEED = 11


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(12):
        near = _distances(x, centres).argmin(1)
        for j in range(len(centres)):
            if (mine := near == j).any():
                centres[j] = x[mine].mean(0)
    return centres


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1), 0)


class MultiIndex:
    """Codebooks of the two halves of unit vectors, and the number of cells that a query visits.

    ``sample`` has the width of the longest vectors; shorter ones are filled up with zeros, which changes no cosine.
    """

    def __init__(self, sample: np.ndarray, entries: int):
        rng = np.random.default_rng(_SEED)
        x = sample
        self.cut = x.shape[1] // 2
        self.left, self.right = _kmeans(x[:, : self.cut], entries, rng), _kmeans(x[:, self.cut :], entries, rng)
        # pairs at exactly the least cosine show how far the traversal has to go
        y = x[rng.integers(len(x), size=min(4000, 4 * len(x)))]
        noise = rng.normal(size=y.shape)
        noise -= (noise * y).sum(1, keepdims=True) * y
        noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-30)
        z = COSINE * y + np.sqrt(1 - COSINE**2) * noise
        home = self.cells(y, 1)[:, 0]
        self.most = len(self.left) * len(self.right)
        ranks = self.ranks(z, home)
        self.visits = self.most if self.most <= FEW else int(np.sort(ranks)[min(len(ranks) - 1, int(np.ceil(RECALL * len(ranks))))] + 1)

    def cells(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The nearest cells of each unit vector, nearest first.

        Both halves' entries are sorted by distance; the cell of their i-th and j-th entries can be among the first v only if
        (i+1)*(j+1) <= v, so the merged sequence is a choice among those.
        """
        d1, d2 = _distances(x[:, : self.cut], self.left), _distances(x[:, self.cut :], self.right)
        o1, o2 = d1.argsort(1, kind="stable"), d2.argsort(1, kind="stable")
        i, j = np.meshgrid(np.arange(d1.shape[1]), np.arange(d2.shape[1]), indexing="ij")
        able = (i + 1) * (j + 1) <= visits
        i, j = i[able], j[able]
        total = np.take_along_axis(d1, o1, 1)[:, i] + np.take_along_axis(d2, o2, 1)[:, j]
        first = total.argsort(1, kind="stable")[:, :visits]
        return (np.take_along_axis(o1, i[first], 1) * d2.shape[1] + np.take_along_axis(o2, j[first], 1)).astype(np.int32)


    def ranks(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many other cells each unit vector may visit before the given one, cells at the same distance counted in."""
        d1, d2 = _distances(x[:, : self.cut], self.left), _distances(x[:, self.cut :], self.right)
        row = np.arange(len(x))
        reach = d1[row, cells // d2.shape[1]] + d2[row, cells % d2.shape[1]]
        d2 = np.sort(d2, axis=1)
        return np.array([np.searchsorted(far, t - near, side="right").sum() - 1 for near, far, t in zip(d1, d2, np.nextafter(reach, np.inf), strict=True)], np.int64).clip(0)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of unit length, filled up with zeros to ``width``."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        out = flat.reshape(len(column), width)
    else:
        out = np.zeros((len(column), width))
        row = np.repeat(np.arange(len(sizes)), sizes)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    # first by the largest component, as squares of very small or large ones would vanish or overflow
    out = out / np.abs(out).max(1, keepdims=True)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _slices(batch: pa.RecordBatch, width: int) -> Iterator[pa.RecordBatch]:
    rows = max(1, min(2048, (1 << 20) // max(1, width)))
    for a in range(0, batch.num_rows, rows):
        yield batch.slice(a, rows)


def _placed(index: MultiIndex, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, width):
                cells = index.cells(_matrix(part.column("embedding"), width), index.visits)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32)), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "cells"])

    return run


def _reached(index: MultiIndex, width: int, probes: pa.Table):
    """Rows (rep, label, d, embedding) against all probes: (rank, n), how many linked pairs have their cell at which place."""
    groups: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(probes.column("label").to_pylist(), probes.column("d").to_pylist(), strict=True)):
        groups.setdefault(key, []).append(k)
    ids, q = probes.column("rep").to_numpy(), _matrix(probes.column("embedding").combine_chunks(), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], int] = {}
        for batch in batches:
            for part in _slices(batch, width):
                x, rep = _matrix(part.column("embedding"), width), part.column("rep").to_numpy()
                rows: dict[tuple, list[int]] = {}
                for i, key in enumerate(zip(part.column("label").to_pylist(), part.column("d").to_pylist(), strict=True)):
                    if key in groups:
                        rows.setdefault(key, []).append(i)
                for key, mine in rows.items():
                    mine, probe = np.array(mine), np.array(groups[key])
                    i, k = np.nonzero((x[mine] @ q[probe].T >= COSINE) & (rep[mine][:, None] != ids[probe]))
                    if len(i):
                        pairs, n = np.unique(np.stack([probe[k], index.cells(x[mine], 1)[i, 0]]), axis=1, return_counts=True)
                        for a, c, m in zip(*pairs.tolist(), n.tolist(), strict=True):
                            found[a, c] = found.get((a, c), 0) + m
        if found:
            keys = np.array(list(found), np.int64)
            ranks = index.ranks(q[keys[:, 0]], keys[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(ranks), pa.array(list(found.values()), pa.int64())], names=["rank", "n"])

    return run


def reach(index: MultiIndex, classes: DataFrame, width: int, probes: pa.Table) -> list[tuple[int, int]]:
    """(cells visited, linked pairs found by then), ascending: the probes against all rows, by brute force.

    One pass over the rows; what comes back is a count per rank, of which there are as many as cells.
    """
    rows = classes.select("rep", "label", F.size("embedding").alias("d"), "embedding")
    counts = rows.mapInArrow(_reached(index, width, probes), "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).orderBy("rank").collect()
    return list(zip([r["rank"] + 1 for r in counts], np.cumsum([r.n for r in counts]).tolist(), strict=True))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group..., home, vec_id, copies, embedding, mine, cells), sorted by group; home says whether the row is indexed there,
    ``mine`` is the row's own cell, ``cells`` what an indexed row visits itself.

    Gives each vector's count of links (with copies) and a spanning forest of the group's links: rows (vec_id, other, n).
    """
    for member, vec, copies, x, mine, cells in _grouped(batches):
        inner, outer = np.flatnonzero(member), np.flatnonzero(~member)
        if not len(inner) or not len(outer):
            continue
        counts = np.zeros(len(vec), np.int64)
        far = int(max(mine.max(), cells.max())) + 1
        visited = np.sort((np.arange(len(inner))[:, None] * far + cells).ravel())

        def near() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for a in range(0, len(outer), 256):
                q = outer[a : a + 256]
                i, k = np.nonzero(x[q] @ x[inner].T >= COSINE)
                i, j = q[i], inner[k]
                other = vec[i] != vec[j]
                i, j, k = i[other], j[other], k[other]
                np.add.at(counts, i, copies[j])
                # the indexed one counts the visitor only if it doesn't visit the visitor's home itself
                back = k * far + mine[i]
                lone = visited[np.minimum(np.searchsorted(visited, back), len(visited) - 1)] != back
                np.add.at(counts, j[lone], copies[i[lone]])
                yield i, j

        edges = np.array([(vec[i], vec[j]) for i, j in spanning(np.arange(len(vec)), near())], np.int64).reshape(-1, 2)
        some = np.flatnonzero(counts)
        if len(some) + len(edges):
            others = pa.array([*[None] * len(some), *edges[:, 1].tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[vec[some], edges[:, 0]], pa.int64()), others, pa.array(np.r_[counts[some], np.zeros(len(edges), np.int64)], pa.int64())], names=["vec_id", "other", "n"])


_GROUP = ["label", "d", "cell", "outer", "inner"]


def _grouped(batches: Iterator[pa.RecordBatch]):
    """Arrays of each group of a stream of batches that is sorted by its group columns."""
    held: list[pa.RecordBatch] = []

    def flush():
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        home = t.column("home").to_numpy(zero_copy_only=False)
        cells = t.column("cells").filter(t.column("home"))
        cells = cells.flatten().to_numpy(zero_copy_only=False).reshape(int(home.sum()), -1) if home.any() else np.zeros((0, 1), np.int32)
        x = _matrix(t.column("embedding"), t.column("d")[0].as_py())
        return home, t.column("vec_id").to_numpy(), t.column("copies").to_numpy(), x, t.column("mine").to_numpy().astype(np.int64), cells

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in _GROUP]
        change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
        cuts = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(k[a] for k in keys)
            if held and key != last:
                yield flush()
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield flush()


def fitted(classes: DataFrame, width: int, n: int) -> MultiIndex:
    """An index for the vectors of ``classes`` (rep, label, embedding): codebooks fitted on a bounded sample, visits by recall.

    The visits first suit pairs at the very threshold; then a bounded number of probes is held against all rows, and where the
    traversal reaches less than RECALL of the linked pairs that there are, it is made longer.
    """
    rows = classes.select("rep", "label", F.size("embedding").alias("d"), "embedding")
    sample = rows.orderBy(F.xxhash64("rep"), "rep").limit(max(PROBES, min(SAMPLE, VALUES // width))).toArrow()
    index = MultiIndex(_matrix(sample.column("embedding").combine_chunks(), width), int(np.clip(np.sqrt(n / 512), 4, LARGEST)))
    if index.visits < index.most and (found := reach(index, classes, width, sample.slice(0, PROBES))):
        enough = next(v for v, m in found if m >= RECALL * found[-1][1])
        index.visits = min(index.most, max(index.visits, enough))
    return index


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, links being cosines of at least COSINE within one label.

    Vectors that are null, zero, or hold null or non-finite components, and those without label, link with nothing (n_links 0,
    their own component); vectors of different lengths don't link with each other. Equal vectors of a label are one class: they
    are linked with each other, and the search goes over classes. Cosines are exact (double precision); which pairs are
    compared is the index's choice (see ``fitted``), all of them where cells are few. Rows with a null vec_id come back with
    null component and are compared with nothing; rows that share a vec_id count as copies.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding", "label")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    sound = rows.where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda v: v != 0))
    classes = stored(sound.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    shape = classes.agg(F.max(F.size("embedding")).alias("width"), F.count(F.lit(1)).alias("n")).first()
    if not shape.n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    index = fitted(classes, shape.width, shape.n)

    ready = classes.select(F.col("rep").alias("vec_id"), "label", F.size("embedding").alias("d"), "embedding", "copies")
    label_type, item_type = rows.schema["label"].dataType.simpleString(), rows.schema["embedding"].dataType.simpleString()
    placed = stored(ready.mapInArrow(_placed(index, shape.width), f"vec_id long, label {label_type}, d int, embedding {item_type}, copies long, cells array<int>"), "placed")

    base = ["label", "d", "cell"]
    visits = placed.select("label", "d", "vec_id", "copies", "embedding", F.col("cells")[0].alias("mine"), F.explode("cells").alias("cell"))
    load = visits.groupBy(*base).agg(F.count_if(F.col("cell") == F.col("mine")).alias("inside"), F.count(F.lit(1)).alias("all")).where("inside > 0")
    inner_blocks, outer_blocks = (F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int") for c in ("inside", "all"))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), n).cast("int")
    others = ["vec_id", "copies", "embedding", "mine"]
    visitors = visits.join(load, base).select(*base, block(outer_blocks).alias("outer"), F.explode(F.sequence(F.lit(0), inner_blocks - 1)).alias("inner"), F.lit(False).alias("home"), *others, F.lit(None).cast("array<int>").alias("cells"))
    homes = placed.withColumn("mine", F.col("cells")[0]).withColumn("cell", F.col("mine")).join(load, base)
    homes = homes.select(*base, F.explode(F.sequence(F.lit(0), outer_blocks - 1)).alias("outer"), block(inner_blocks).alias("inner"), F.lit(True).alias("home"), *others, "cells")
    dealt = homes.union(visitors).repartition(*_GROUP).sortWithinPartitions(*_GROUP)
    found = stored(dealt.mapInArrow(_links, "vec_id long, other long, n long"), "links")

    counts = found.groupBy("vec_id").agg(F.sum("n").alias("far"))
    groups = components(found.where("other is not null"), "vec_id", "other").toDF("rep", "component")
    per_class = classes.join(counts.withColumnRenamed("vec_id", "rep"), "rep", "left").join(groups, "rep", "left")
    per_class = per_class.select("rep", "copies", (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    several = classes.where("copies > 1").select("label", "embedding", "rep")
    other = sound.join(several, ["label", "embedding"]).where("vec_id <> rep").select("vec_id", "rep")
    members = other.join(per_class.select("rep", "n_links", "component_id"), "rep").select("vec_id", "n_links", "component_id")
    known = members.union(per_class.select(F.col("rep").alias("vec_id"), "n_links", "component_id")).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(known, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
