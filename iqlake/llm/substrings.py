"""Removal of repeated word sequences, decided by suffix automata of reference shards.

A window is a run of consecutive words of one document. Where the corpus is its own reference, sending every automaton to
every task would cost the square of the corpus. So the reference is cut into shards by content, such that two equal windows
always meet: a window's anchor is the smallest hash among its short word runs, equal windows have equal anchors, and a shard
is what holds one anchor. A document's passages go to the shards of their anchors and nowhere else. Passages that are
the same from end to end are counted once, first within a task and then over all, so a shard holds different passages only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import U64, Words, batch_of, mix, powers, runs_of, steps, stored, unused

#: Words of a window, and of the runs among which its anchor is chosen.
WINDOW, ANCHOR = 20, 8
#: Different passages from which on an anchor's shard is dealt out by whole windows instead.
WIDE = 4096
#: Passages that a task compares among themselves before it passes them on.
LOCAL = 1 << 19
_DIGEST_BASE = U64(0xA0761D6478BD642F)
_DIGEST_INVERSE = U64(pow(int(_DIGEST_BASE), -1, 1 << 64))


def passages(words: Words, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows that share an anchor: (text, anchor hash, content hash, first window, windows).

    Windows lie within one text; ``first window`` counts words from the text's start.
    """
    h = words.hashes()
    none = (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    n = len(h) - window + 1
    if n <= 0:
        return none
    text_of = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    inside = text_of[:n] == text_of[window - 1 :]
    grams = runs_of(h, anchor)
    order = (grams & ~U64(0xFFFFFFFF)) | np.arange(len(grams), dtype=U64)
    reach, low, size = window - anchor + 1, order, 1
    while size * 2 <= reach:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < reach:
        low = np.minimum(low[: n], low[reach - size :][:n])
    at = (low[:n] & U64(0xFFFFFFFF)).astype(np.int64)
    keep = np.flatnonzero(inside)
    if not len(keep):
        return none
    at = at[keep]
    new = np.r_[True, (np.diff(at) != 0) | (np.diff(keep) != 1) | (np.diff(text_of[keep]) != 0)]
    first = keep[new]
    count = np.diff(np.r_[np.flatnonzero(new), len(keep)])
    total = np.r_[U64(0), np.cumsum(h * powers(_DIGEST_BASE, len(h)), dtype=U64)]
    digest = mix((total[first + count + window - 1] - total[first]) * powers(_DIGEST_INVERSE, len(h))[first] + count.astype(U64))
    text = text_of[first]
    return text, grams[at[new]], digest, first - words.bounds[text], count


_MARK = "doc_id long, anchor long, digest long, start int, n int, later boolean"
_MARK_SCHEMA = pa.schema([("doc_id", pa.int64()), ("anchor", pa.int64()), ("digest", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("later", pa.bool_())])


def _local(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Mark all but the first of the same passages in a task; marked ones are spread, as they need no partner any more."""
    doc, anchor, digest, start, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((start, doc, digest, anchor))
    doc, anchor, digest, start, n = (c[order] for c in (doc, anchor, digest, start, n))
    same = np.r_[False, (anchor[1:] == anchor[:-1]) & (digest[1:] == digest[:-1])]
    group = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
    later = same & ((doc != doc[group]) | (start != start[group]))
    keep = later | ~same
    anchor = np.where(later, mix(doc.astype(U64) * U64(31) + start.astype(U64)), anchor)
    return batch_of(_MARK_SCHEMA, *(c[keep] for c in (doc, anchor, digest, start.astype(np.int32), n.astype(np.int32), later)))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, held = [], 0
    for batch in batches:
        for step in steps(batch):
            ids = step.column(0).to_numpy(zero_copy_only=False)
            text, *rest = passages(Words(step.column(1)))
            parts.append((ids[text], *rest))
            held += len(text)
            if held >= LOCAL:
                yield _local(parts)
                parts, held = [], 0
    if held:
        yield _local(parts)


class Automaton:
    """Suffix automaton of a growing set of word sequences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def _state(self, size: int, link: int, step: dict) -> int:
        self.next.append(step)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _split(self, p: int, w: bytes) -> int:
        """The state of p's longest word sequence followed by w, split off where the state there is longer."""
        q = self.next[p][w]
        if self.size[q] == self.size[p] + 1:
            return q
        twin = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            if w in self.next[last]:
                last = self._split(last, w)
                continue
            new, p = self._state(self.size[last] + 1, 0, {}), last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, w)
            last = new

    def statistics(self, words: list[bytes]) -> list[int]:
        """Per word, the length of the longest sequence ending there that the automaton holds."""
        state, size, out = 0, 0, []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                size = self.size[state]
            if w in self.next[state]:
                state = self.next[state][w]
                size += 1
            out.append(size)
        return out


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, doc_id, start, text) in that order: match each passage against the shard's earlier ones, then add it."""
    shard, automaton, last = None, Automaton(), None
    for batch in batches:
        found = ([], [])
        for key, doc, start, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, doc, start) == last:
                continue
            last = (key, doc, start)
            if key != shard:
                shard, automaton = key, Automaton()
            words = text.split(b" ")
            for j, size in enumerate(automaton.statistics(words)):
                if size >= WINDOW:
                    found[0].append(doc)
                    found[1].append(start + j - WINDOW + 1)
            automaton.add(words)
        if found[0]:
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int32()), pa.array([1] * len(found[0]), pa.int32())], names=["doc_id", "start", "n"])


def _quote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the passages that need an automaton: rows (shard, doc_id, start, text)."""
    for batch in batches:
        for step in steps(batch):
            out = ([], [], [], [])
            for doc, text, wanted in zip(*(c.to_pylist() for c in step.columns), strict=True):
                words = (text or "").encode().split()
                pieces = []
                for w in wanted:
                    if w["wide"]:
                        pieces += [(None, w["start"] + j, 1) for j in range(w["n"])]
                    else:
                        pieces.append((w["anchor"], w["start"], w["n"]))
                for key, start, n in set(pieces):
                    piece = b" ".join(words[start : start + n + WINDOW - 1])
                    out[0].append(key)
                    out[1].append(doc)
                    out[2].append(start)
                    out[3].append(piece)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["anchor", "doc_id", "start", "text"])


def _without(text: str | None, spans: list) -> tuple[str, int, int]:
    """(the words left, joined; all words; words removed) of a text without the words that the runs of windows cover."""
    words = (text or "").encode().split()
    left = words
    if spans:
        edge = np.zeros(len(words) + 1, np.int32)
        at = np.array([(r["start"], r["start"] + r["n"] + WINDOW - 1) for r in spans], np.int64)
        np.add.at(edge, np.minimum(at[:, 0], len(words)), 1)
        np.add.at(edge, np.minimum(at[:, 1], len(words)), -1)
        left = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
    return b" ".join(left).decode(), len(words), len(words) - len(left)


def _cut(text: str):
    """Rows with ``text`` and, last, their runs: the rows without the runs, with what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in (step for batch in batches for step in steps(batch, text)):
            texts, runs = step.column(text).to_pylist(), step.column(step.num_columns - 1).to_pylist()
            kept, n_words, n_removed = zip(*map(_without, texts, runs), strict=True)
            columns = [*step.columns[:-1], pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*step.schema.names[:-1], "kept", "n_words", "n_removed"])

    return run


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n): runs of n windows from word ``start`` whose word sequence starts earlier in the corpus."""
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text")
    by_anchor = Window.partitionBy("anchor")
    place = F.struct("doc_id", "start")
    # same passages are next to each other in a shard sorted by digest: one sort serves all of these
    first = F.first(place).over(Window.partitionBy("anchor", "digest").orderBy("doc_id", "start"))
    seen = texts.mapInArrow(_marks, _MARK).repartition("anchor").withColumn("dup", place != first)
    marks = (
        seen.withColumn("n_kept", F.count_if(~F.col("dup")).over(by_anchor))
        .withColumn("several", F.min("digest").over(by_anchor) != F.max("digest").over(by_anchor))
        .where("later or dup or several")
        .select("doc_id", "anchor", "start", "n", (F.col("later") | F.col("dup")).alias("gone"), (F.col("n_kept") > WIDE).alias("wide"))
    )
    marks = stored(marks, "marks")
    wanted = marks.where("not gone").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "start", "n", "wide")).alias("wanted"))
    quoted = texts.join(wanted, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_quote, "anchor long, doc_id long, start int, text binary")
    shard = F.coalesce("anchor", F.xxhash64("text")).alias("shard")
    ordered = quoted.select(shard, "doc_id", "start", "text").repartition("shard").sortWithinPartitions("shard", "doc_id", "start")
    return marks.where("gone").select("doc_id", "start", "n").union(ordered.mapInArrow(_stream, "doc_id long, start int, n int"))


def dedup(docs: DataFrame) -> DataFrame:
    """Remove each word that a window of WINDOW words covers whose word sequence also starts earlier.

    Earlier means a smaller doc_id, or an earlier word of the same document; windows are judged on the input. Returns the
    columns of ``docs`` and kept (the words left, joined by one blank), n_words, n_removed. Words are
    ``[^\\x20\\x09-\\x0D]+``, unchanged. Null and empty texts have no words; texts shorter than a window stay whole; rows
    with a null doc_id keep all words and count for nobody. Rows that share a doc_id are one document told several times:
    the same window at the same word of it is no repeat, and each such row is cut at all the words found for it.
    Input columns named kept, n_words or n_removed are replaced.
    """
    docs = docs.drop("kept", "n_words", "n_removed")
    key, held = unused("doc", docs), unused("runs", docs)
    runs = repeated_windows(docs).groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start", "n")).alias(held))
    joined = docs.join(runs, F.col("doc_id") == F.col(key), "left").drop(key)
    others = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return joined.mapInArrow(_cut("text"), ", ".join([*others, "kept string, n_words long, n_removed long"]))
