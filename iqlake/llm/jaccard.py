"""Similarity join on word n-grams by parity sketches.

A document's n-grams fall into parts by hash, and a part's code is the XOR of their hashes. Two documents that are similar
enough differ in at most d n-grams, hence in at most d parts, so of the first d+1 parts that are not empty in one of them, one
is the same in both (pigeonhole): that part's code is the join key. The fine sketch of a document flips one bit per n-gram, so
the number of bits in which two sketches differ is at most the number of n-grams that only one of the documents has: that rules
out most of what met by chance, and the n-gram sets of what is left are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, bucketed, components, drop_path, mix, new_path, runs_of, spanning, steps, stored

#: Words of an n-gram; two sets are linked where BELOW * |both| >= ABOVE * |either|.
WORDS, ABOVE, BELOW = 4, 85, 100
#: Sizes of a band grow by this factor; documents of a block that are compared within one task.
BAND, BLOCK = 1.5, 2048
#: Forests of a group that are verified at once when its groups of documents are gone over again; bits per n-gram, at least, of
#: the fine sketch of a pair's second test.
WIDTH, FINE = 4, 8
#: Bytes at most of the folded fine sketch that travels with every key of a document.
COARSE = 256
_PART, _CODE = U64(0x8EBC6AF09C88C6E3), U64(0x589965CC75374CC3)


def difference(n):
    """The most n-grams in which a set of n can differ from one that it is linked with: either*(1-s), either <= n/s."""
    return n * (BELOW - ABOVE) // ABOVE


def _bands() -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return np.array(out, np.int64)


#: Least sizes of the bands. Their number stays below 64, so that a key has room for it.
BANDS = _bands()[:63]


def parts_of(band: np.ndarray) -> np.ndarray:
    """Number of parts of a band: enough for its largest sets, and some to spare for empty ones."""
    top = np.minimum(BANDS[np.minimum(band + 1, len(BANDS) - 1)], 1 << 40)
    return difference(top) * 21 // 20 + 6


def sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts, sorted within each, and their bounds. Shorter texts are one n-gram as a whole."""
    h = words.hashes(lower=True)
    sizes = np.diff(words.bounds)
    text = np.repeat(np.arange(len(sizes)), sizes)
    n = len(h) - WORDS + 1
    grams, owner = np.zeros(0, U64), np.zeros(0, np.int64)
    if n > 0:
        inside = text[:n] == text[WORDS - 1 :]
        grams, owner = runs_of(h, WORDS)[inside], text[:n][inside]
    short = np.flatnonzero((sizes > 0) & (sizes < WORDS))
    if len(short):
        whole = np.array([mix(np.array([int(sum(int(x) * (j * 2 + 3) for j, x in enumerate(h[words.bounds[i] : words.bounds[i + 1]]))) % (1 << 64)], U64) + U64(sizes[i]))[0] for i in short], U64)
        grams, owner = np.r_[grams, whole], np.r_[owner, short]
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.r_[True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[new], owner[new]
    return grams, np.searchsorted(owner, np.arange(len(sizes) + 1))


def sketch(grams: np.ndarray, bounds: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bounds) of each set's parts in the given band. A part's code is the XOR of its n-grams' 64-bit hashes."""
    parts = np.where(band >= 0, parts_of(np.maximum(band, 0)), 0)
    at = np.r_[0, np.cumsum(parts)]
    owner = np.repeat(np.arange(len(parts)), np.diff(bounds))
    use = parts[owner] > 0
    g, owner = grams[use], owner[use]
    place = at[owner] + (mix(g * _PART) % np.maximum(parts[owner], 1).astype(U64)).astype(np.int64)
    codes = np.zeros(at[-1], U64)
    np.bitwise_xor.at(codes, place, mix(g ^ _CODE))
    return codes, at


def _bands_of(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A set's own band, and the next one where a larger partner may be in that, else -1. Sets without slack have none."""
    own = np.searchsorted(BANDS, n, side="right") - 1
    above = np.searchsorted(BANDS, n * BELOW // ABOVE, side="right") - 1
    some = difference(n) > 0
    return np.where(some, own, -1), np.where(some & (above > own), own + 1, -1)


def _keys(grams: np.ndarray, bounds: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, owner): the first d+1 parts that aren't empty; where a set has too few, its empty parts too, marked as such."""
    n = np.diff(bounds)
    codes, at = sketch(grams, bounds, band)
    sizes = np.diff(at)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    full = codes != 0
    rank = np.cumsum(full)
    rank -= np.r_[0, rank][at[:-1]][owner] if len(owner) else 0
    need = difference(n) + 1
    total = np.bincount(owner, full, minlength=len(n)).astype(np.int64)
    lacking = total < need
    take = (full & (rank <= need[owner])) | (~full & lacking[owner])
    part = np.arange(len(owner)) - at[:-1][owner]
    key = mix(codes ^ mix(part.astype(U64) * U64(64) + band[owner].astype(U64) + U64(1) + np.where(full, U64(0), U64(1 << 40))))
    return ((key & ~U64(63)) | band[owner].astype(U64))[take], owner[take]


_DOC = "doc_id long, n long, f1 long, f2 long, keys array<long>"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set = set()
    for batch in batches:
        for step in steps(batch):
            grams, bounds = sets(Words(step.column(1)))
            n = np.diff(bounds)
            first = lambda v: np.where(n > 0, np.add.reduceat(np.r_[v, U64(0)], np.minimum(bounds[:-1], len(v))), U64(0)) if len(n) else np.zeros(0, U64)
            f1, f2 = first(mix(grams ^ _PART)), first(mix(grams * _CODE + U64(7)))
            # one copy that a task meets gets the keys; a row without doc_id can't stand for its copies
            fresh = step.column(0).is_valid().to_numpy(zero_copy_only=False).copy()
            for i, f in enumerate(zip(n.tolist(), f1.tolist(), f2.tolist(), strict=True)):
                if fresh[i]:
                    fresh[i] = f not in seen
                    seen.add(f)
            if len(seen) > 1 << 18:
                seen.clear()
            lists: list[list[np.ndarray]] = []
            for band in _bands_of(n):
                keys, owner = _keys(grams, bounds, np.where(fresh, band, -1))
                lists.append(np.split(keys, np.searchsorted(owner, np.arange(1, len(n)))))
            joined = [np.concatenate(x) for x in zip(*lists, strict=True)]
            offsets = np.r_[0, np.cumsum([len(x) for x in joined])].astype(np.int32)
            flat = (np.concatenate(joined) if joined else np.zeros(0, U64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array(n, pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "n", "f1", "f2", "keys"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, doc_id) in that order, those whose key another document has too."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k, d = (batch.column(i).to_numpy() for i in (0, 1))
        if held is not None:
            k, d = np.r_[held[0], k], np.r_[held[1], d]
        new = np.r_[True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])]
        k, d = k[new], d[new]
        same = k[1:] == k[:-1]
        keep = np.r_[False, same] | np.r_[same, False]
        # the last row's fate is open; a row before it with its key stays as its witness
        tail = 2 if len(k) > 1 and same[-1] else 1
        held = (k[-tail:], d[-tail:])
        out = keep.copy()
        out[-tail:] = False
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(k[out]), pa.array(d[out])], names=["key", "doc_id"])
    if held is not None and len(held[0]) > 1:
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["key", "doc_id"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, coarse sketch, fine sketch, sorted n-gram hashes)."""
    for batch in batches:
        for step in steps(batch):
            grams, bounds = sets(Words(step.column(1)))
            n = np.diff(bounds)
            each = [grams[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            fine = [fine_sketch(g) for g in each]
            cols = [[folded(f, COARSE // 8).tobytes() for f in fine], [f.tobytes() for f in fine], [g.tobytes() for g in each]]
            yield pa.RecordBatch.from_arrays([step.column(0), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in cols)], names=["doc_id", "n", "coarse", "fine", "grams"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows of a stream that is sorted by its first two columns, by these."""
    rows, key = [], None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != key:
                if rows:
                    yield rows
                rows, key = [], row[:2]
            rows.append(row)
    if rows:
        yield rows


def _near(x: int, others: np.ndarray, n: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Those of the places ``others`` whose sizes and sketches allow a link with place x."""
    low, high = np.minimum(n[others], n[x]), np.maximum(n[others], n[x])
    able = low * BELOW >= high * ABOVE
    others, low = others[able], low[able]
    apart = np.bitwise_count(bits[others] ^ bits[x]).sum(1, dtype=np.int64)
    return others[apart <= difference(low)]


def _tree(n: np.ndarray, bits: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with close sketches, found breadth first: what is reached isn't compared again."""
    found: list[tuple[int, int]] = []
    left, queue = np.arange(len(n)), []
    while len(left):
        if queue:
            x = queue.pop()
        else:
            x, left = int(left[0]), left[1:]
        near = _near(x, left, n, bits)
        if len(near):
            found += [(x, y) for y in near.tolist()]
            queue += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
    return found


def _trees(n: np.ndarray, bits: np.ndarray, label: np.ndarray, barred: set[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """Up to ``width`` spanning forests without a common edge, over pairs of different labels that aren't barred."""
    _, label, sizes = np.unique(label, return_inverse=True, return_counts=True)
    small = np.flatnonzero(label != sizes.argmax())
    place, pairs = np.arange(len(n)), []
    for x in small.tolist():
        # two documents outside the largest component meet once
        others = place[(label != label[x]) & ((label == sizes.argmax()) | (place > x))]
        near = _near(x, others, n, bits)
        pairs += [(min(x, y), max(x, y)) for y in near.tolist() if (min(x, y), max(x, y)) not in barred]
    out: list[tuple[int, int]] = []
    for _ in range(width):
        if not pairs:
            break
        got = spanning(label, [tuple(np.array(pairs).T)])
        out += got
        used = set(got)
        pairs = [p for p in pairs if p not in used]
    return out


def _forest(width: int):
    """Rows (key, block, doc_id, other, n, label, bits): pairs that connect each group's documents with close sketches.

    Without ``width``, one forest. With it, documents of one label count as connected, rows with ``other`` name a pair that is
    known not to be linked, and so many forests are given that edges that turn out not to be links have stand-ins.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: tuple[list, ...] = ([], [], [])
        for rows in _groups(batches):
            # a doc_id with several texts has a place for each of them
            docs = sorted({(doc, n, label, bits) for _, _, doc, other, n, label, bits in rows if other is None})
            if len(docs) < 2:
                continue
            ids, n, label = (np.array([d[k] for d in docs], np.int64) for k in (0, 1, 2))
            places: dict[int, list[int]] = {}
            for i, d in enumerate(ids.tolist()):
                places.setdefault(d, []).append(i)
            each = [np.frombuffer(d[3], U64) for d in docs]
            least = min(map(len, each))
            bits = np.stack([folded(x, least) for x in each])
            barred = {(min(i, j), max(i, j)) for _, _, doc, other, *_ in rows if other is not None for i in places.get(doc, ()) for j in places.get(other, ())}
            for x, y in _trees(n, bits, label, barred, width) if width else _tree(n, bits):
                if ids[x] == ids[y]:
                    continue
                out[0].append(int(ids[min(x, y)]))
                out[1].append(int(ids[max(x, y)]))
                out[2].append(rows[0][0])
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b", "key"])
                out = ([], [], [])
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b", "key"])

    return run


def fine_sketch(grams: np.ndarray) -> np.ndarray:
    """Parity of a power of two of positions, at least FINE per n-gram. Halves folded by XOR give the sketch of half the size."""
    size = 1 << max(6, int(len(grams) * FINE - 1).bit_length())
    at = (mix(grams ^ _PART) & U64(size - 1)).astype(np.int64)
    out = np.zeros(size // 64, U64)
    np.bitwise_xor.at(out, at & (size // 64 - 1), U64(1) << (at // (size // 64)).astype(U64))
    return out


def folded(x: np.ndarray, most: int) -> np.ndarray:
    """A fine sketch folded by XOR until it has at most so many numbers."""
    while len(x) > most:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def apart(x: np.ndarray, y: np.ndarray) -> int:
    """Differing bits of two fine sketches, the larger one folded: a lower bound of the sets' symmetric difference."""
    small, large = sorted((x, y), key=len)
    return int(np.bitwise_count(small ^ folded(large, len(small))).sum())


def _by_pair(test):
    """Rows (a, b, ...): whether ``test`` of the other columns holds, a few rows at a time as sets can be large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ok = [test(*row) for row in zip(*(c.to_pylist() for c in part.columns[2:]), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ok, pa.bool_())], names=["a", "b", "linked"])

    return run


def _close(nx: int, ny: int, x: bytes, y: bytes) -> bool:
    """Whether a pair's fine sketches allow a link."""
    return apart(np.frombuffer(x, U64), np.frombuffer(y, U64)) <= difference(min(nx, ny))


def _linked(x: bytes, y: bytes) -> bool:
    """Whether a pair is linked, by its whole sets."""
    x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return BELOW * both >= ABOVE * (len(x) + len(y) - both)


def _verify(pairs: DataFrame, known: DataFrame, folder: str) -> DataFrame:
    """(a, b, linked). The pairs' fine sketches travel first, and whole sets only for those that these leave open."""
    fine = known.select("doc_id", "n", "fine")
    open_ = pairs.join(fine.toDF("a", "nx", "x"), "a").join(fine.toDF("b", "ny", "y"), "b").select("a", "b", "nx", "ny", "x", "y")
    first = stored(open_.mapInArrow(_by_pair(_close), "a long, b long, linked boolean"), "close", folder)
    grams = known.select("doc_id", "grams")
    rest = first.where("linked").select("a", "b").join(grams.toDF("a", "x"), "a").join(grams.toDF("b", "y"), "b").select("a", "b", "x", "y")
    return first.where("not linked").union(rest.mapInArrow(_by_pair(_linked), "a long, b long, linked boolean"))


def _across(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct pairs whose ends have different labels."""
    la, lb = labels.toDF("a", "la"), labels.toDF("b", "lb")
    ends = edges.select("a", "b").distinct().join(la, "a", "left").join(lb, "b", "left")
    return ends.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def _blocks(met: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows (key, block, doc_id), rows (key, doc_id, block, n_blocks) of the keys with several blocks).

    A key with many documents is dealt out in blocks, so that a task holds a bounded part of it. One more block has one document
    of each, by which blocks of copies of the same text find together.
    """
    n_blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    dealt = met.select("key", "doc_id", n_blocks.alias("n_blocks"), F.pmod(F.xxhash64("doc_id"), n_blocks).cast("int").alias("block"))
    large = dealt.where("n_blocks > 1")
    firsts = large.groupBy("key", "block").agg(F.min("doc_id").alias("doc_id")).select("key", F.lit(-1).alias("block"), "doc_id")
    return dealt.select("key", "block", "doc_id").union(firsts), large


def _strays(large: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (key, block, doc_id) in which all documents of a key with several blocks meet that aren't connected by ``labels``.

    Documents outside the key's largest component go to each of its blocks. They are dealt out in blocks themselves, and a
    block is their block times the other one. A key whose documents are one component by now has no rows.
    """
    named = large.join(labels.toDF("doc_id", "label"), "doc_id", "left").select("key", "doc_id", "block", "n_blocks", F.coalesce("label", "doc_id").alias("label"))
    most = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("most"), (F.sum("n") - F.max("n")).alias("strays")).where("strays > 0")
    open_ = named.join(most, "key")
    n_sides = F.ceil(F.col("strays") / BLOCK).cast("int")
    side = F.pmod(F.xxhash64("doc_id", F.lit(1)), n_sides).cast("int")
    to = lambda i, j: (i.cast("long") * F.lit(1 << 31) + j).alias("block")
    stray = open_.where("label <> most").select("key", side.alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("j"), "doc_id")
    held = open_.select("key", F.explode(F.sequence(F.lit(0), n_sides - 1)).alias("i"), F.col("block").alias("j"), "doc_id")
    return stray.union(held).distinct().select("key", to(F.col("i") + 1, F.col("j")), "doc_id")


def _labelled(rows: DataFrame, labels: DataFrame, coarse: DataFrame) -> DataFrame:
    """Rows (key, block, doc_id) as ``_forest`` takes them, with what each document is connected with so far."""
    named = rows.join(labels.toDF("doc_id", "component"), "doc_id", "left").join(coarse, "doc_id")
    return named.select("key", "block", "doc_id", F.lit(None).cast("long").alias("other"), "n", F.coalesce("component", "doc_id").alias("label"), "bits")


def _connected(met: DataFrame, known: DataFrame, given: DataFrame, folder: str) -> tuple[bool, DataFrame]:
    """(any links, labels): the components of exactly verified and ``given`` links, without comparing what is connected already.

    First one pair per document is verified, which connects most of what belongs together, then the other edges of the
    groups' forests that still join two components, then pairs across the blocks of large groups. A pair that sketches took
    for linked but that isn't may have stood for others of its group, so such groups are gone over again, with what is known by
    then, until no pair fails; each time with more forests at once, so that the number of rounds is logarithmic.
    """
    forest = "a long, b long, key long"
    grouped, large = _blocks(met)
    todo, width, coarse = grouped.withColumn("block", F.col("block").cast("long")), 0, known.select("doc_id", "n", F.col("coarse").alias("bits"))
    rows = todo.join(coarse, "doc_id").select("key", "block", "doc_id", F.lit(None).cast("long").alias("other"), "n", F.col("doc_id").alias("label"), "bits")
    edges = stored(_by_group(rows).mapInArrow(_forest(width), forest), "edges", folder)
    tested = stored(_verify(edges.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), known, folder), "tested", folder).union(given)
    labels = components(tested.where("linked"))
    more = stored(_verify(_across(edges, labels).join(tested, ["a", "b"], "left_anti"), known, folder), "tested", folder)
    tested = tested.union(more)
    if not large.isEmpty():
        labels = components(tested.where("linked"))
        strays = stored(_strays(large, labels), "strays", folder)
        found = stored(_by_group(_labelled(strays, labels, coarse)).mapInArrow(_forest(WIDTH), forest), "edges", folder)
        more = stored(_verify(_across(found, labels).join(tested, ["a", "b"], "left_anti"), known, folder), "tested", folder)
        todo, edges, tested, width = todo.union(strays), edges.union(found), tested.union(more), WIDTH
    while True:
        if not more.where("linked").isEmpty():
            labels = components(tested.where("linked"))
        bad = tested.where("not linked").select("a", "b")
        failed = edges.join(bad, ["a", "b"], "left_semi").select("key").distinct()
        todo, width = stored(todo.join(failed, "key", "left_semi"), "again", folder), max(WIDTH, width * 8)
        if todo.isEmpty():
            break
        inside = todo.select("key", "block", F.col("doc_id").alias("a")).join(bad, "a").join(todo.select("key", "block", F.col("doc_id").alias("b")), ["key", "block", "b"], "left_semi")
        barred = inside.select("key", "block", F.col("a").alias("doc_id"), F.col("b").alias("other"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("label"), F.lit(None).cast("binary").alias("bits"))
        edges = stored(_by_group(_labelled(todo, labels, coarse).union(barred)).mapInArrow(_forest(width), forest), "edges", folder)
        more = stored(_verify(edges.select("a", "b").distinct(), known, folder), "tested", folder)
        tested = tested.union(more)
    return not tested.where("linked").isEmpty(), labels


def _by_group(rows: DataFrame) -> DataFrame:
    """Rows dealt by group and sorted by it."""
    return rows.repartition("key", "block").sortWithinPartitions("key", "block")


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: documents linked where 100*|both| >= 85*|either| of their n-grams.

    n-grams are WORDS consecutive words ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, each counted once; a shorter text is one
    n-gram. Null and word-less texts have none and are linked with nothing. component_id is the smallest doc_id reachable.
    Equal sets are one class, represented by one of the copies that have keys, and only representatives are compared. Rows with
    a null doc_id come back with a null component and count for nobody; rows that share a doc_id are linked with each other.
    """
    texts, folder = docs.select(F.col("doc_id").cast("long"), "text"), new_path(docs.sparkSession, "jaccard")
    seen = stored(texts.mapInArrow(_digest, _DOC), "digests")
    prints = seen.where("n > 0 and doc_id is not null").select("doc_id", "n", "f1", "f2", (F.size("keys") > 0).alias("keyed"))
    # only the first copy that a task met has keys, and it need not be the smallest
    rep = F.coalesce(F.min(F.when(F.col("keyed"), F.col("doc_id"))), F.min("doc_id"))
    classes = prints.groupBy("n", "f1", "f2").agg(rep.alias("rep"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    copies = stored(prints.join(classes, ["n", "f1", "f2"]).where("doc_id <> rep").select("doc_id", "rep", "low").distinct(), "copies")
    # a doc_id with several sets stands for all of them: it keeps its keys and connects their classes
    print_ = F.struct("n", "f1", "f2")
    several = stored(prints.groupBy("doc_id").agg(F.min(print_).alias("x"), F.max(print_).alias("y")).where("x <> y").select("doc_id"), "several", folder)
    given = copies.join(several, "doc_id", "left_semi").select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b"), F.lit(True).alias("linked"))

    keyed = seen.where("doc_id is not null and size(keys) > 0").select(F.explode("keys").alias("key"), "doc_id")
    met = keyed.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(_met, "key long, doc_id long")
    met = met.join(copies.select("doc_id").join(several, "doc_id", "left_anti"), "doc_id", "left_anti")
    met = stored(met, "keys", folder)
    # near copies share most of their keys: of the keys with the same documents (by a fingerprint of 128 bits) one will do
    mark = lambda k: F.bit_xor(F.xxhash64("doc_id", F.lit(k)))
    sizes = met.groupBy("key").agg(F.count(F.lit(1)).alias("m"), mark(0).alias("s"), mark(1).alias("t")).where("m > 1")
    lone = sizes.groupBy("m", "s", "t").agg(F.min("key").alias("key")).select("key", "m")
    met = stored(met.join(lone, "key"), "met", folder)
    # every round of tests looks sketches and sets up by doc_id, so they are dealt out by it once
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = texts.where("doc_id is not null").repartition(parts, "doc_id").join(met.select("doc_id").distinct(), "doc_id")
    table = bucketed(known.mapInArrow(_sketches, "doc_id long, n long, coarse binary, fine binary, grams binary"), "doc_id", parts, folder)
    try:
        linked, labels = _connected(met, spark.table(table), stored(given, "given", folder), folder)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        drop_path(spark, folder)

    rows = seen.select("doc_id", F.col("n").alias("n_shingles")).join(copies.groupBy("doc_id").agg(F.min("rep").alias("rep")), "doc_id", "left")
    rows = rows.withColumn("rep", F.coalesce("rep", "doc_id"))
    # of classes whose representative isn't their smallest doc_id
    lower = copies.where("low < rep").groupBy("rep").agg(F.min("low").alias("low"))
    if linked:
        labels = labels.withColumnRenamed("node", "rep")
        rows = rows.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        lower = lower.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    else:
        rows, lower = rows.withColumnRenamed("rep", "component"), lower.withColumnRenamed("rep", "component")
    rows = rows.join(lower.groupBy("component").agg(F.min("low").alias("low")), "component", "left")
    return rows.select("doc_id", "n_shingles", F.least("component", "low").alias("component_id"))
