"""Concatenate-and-cut packing: prefix sums of token totals give every document its global offset."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps, stored

SEQUENCE, END_ID = 2048, 1
_TOKENS = "part long, before long, doc_id long, doc_tokens long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean, ids binary"


#: Fixed value: how byte-level BPE files split a text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@cache
def encoder(path: str, added: bool = True):
    """A function from a text to its ids, for the byte-level BPE in a ``tokenizers`` file.

    The file's own vocabulary is handed to tiktoken, whose merging gives the same ids (tests hold them against each other)
    in about a quarter of the time. The file's added tokens are found in a text first and get their own ids, as ``tokenizers``
    does by default; without ``added`` their strings are ordinary text. Texts that are beyond tiktoken's pattern matching, which
    goes back along runs of about a million white-space characters, are given to ``tokenizers`` itself.
    """
    import tiktoken
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    file = _content(path)
    special = {t["content"]: t["id"] for t in file["added_tokens"]}
    if added and any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path} has added tokens that take more than their own string")
    # the alphabet stands for bytes: printable ones for themselves, the rest in order from U+0100 on
    alphabet = sorted(ByteLevel.alphabet())
    plain = [ord(c) for c in alphabet if ord(c) < 256]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding("corpus", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special if added else {})

    @cache
    def slow() -> Tokenizer:
        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = not added
        return tokenizer

    def encode(text: str) -> list[int]:
        try:
            return encoding.encode(text, allowed_special="all")
        except ValueError:
            return slow().encode(text, add_special_tokens=False).ids

    return encode


@cache
def _content(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def id_type(path: str) -> np.dtype:
    """The unsigned little-endian type that all ids of a file fit: 16 bits, or 32 for large vocabularies."""
    file = _content(path)
    return np.dtype("<u2" if max([*file["model"]["vocab"].values(), *(t["id"] for t in file["added_tokens"])]) < 1 << 16 else "<u4")


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID, added: bool = True) -> DataFrame:
    """(part, before, doc_id, doc_tokens, ids): ids of each text and then ``end_id``.

    ``before`` is the number of ids of earlier rows of the same partition, numbered ``part``. A null text is empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before, encode, kind = TaskContext.get().partitionId(), 0, encoder(path, added), id_type(path)
        for batch in batches:
            for step in steps(batch, most=1 << 20):
                ids = [np.array([*encode(t or ""), end_id], kind).tobytes() for t in step.column(1).to_pylist()]
                n = np.array([len(x) // kind.itemsize for x in ids], np.int64)
                at = before + np.r_[0, np.cumsum(n)[:-1]]
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int64)), pa.array(at), step.column(0), pa.array(n), pa.array(ids, pa.binary())], names=["part", "before", "doc_id", "doc_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _TOKENS)


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, end_id: int = END_ID, added: bool = True) -> DataFrame:
    """Pack all documents into sequences of ``sequence`` ids; one row per piece of a document.

    First pass: tokenize once, keeping each row's offset in its partition and the partition totals. The totals (one
    number per partition) become global offsets by a prefix sum. Second pass: each row alone knows its place in the one long
    stream and is cut where a multiple of ``sequence`` falls, so there is no shuffle. Only the last sequence can be short.

    Columns: doc_id, start, length, ids_crc32 (of unsigned 32-bit little-endian ids), doc_tokens, sequence_id, offset, boundary
    (true where the cut at the piece's end is inside its document), ids (in ``id_type``). Order of documents is that of the input
    partitions; repeated doc_ids are separate documents; a null text gives the end id alone; no rows give no rows.
    ``added``: see ``encoder``.
    """
    tokens = stored(tokenize(docs, path, end_id, added), "tokens")
    totals = sorted((r.part, r.n) for r in tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())
    starts = np.cumsum([0, *(n for _, n in totals)])[:-1]
    offsets = docs.sparkSession.createDataFrame([(p, int(s)) for (p, _), s in zip(totals, starts, strict=True)], "part long, at long")

    def pieces(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, kind = [], id_type(path)
        size = kind.itemsize
        for at, doc, n, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            wide = np.frombuffer(raw, kind).astype("<u4").tobytes()
            start = 0
            while start < n:
                seq, off = divmod(at + start, sequence)
                k = min(sequence - off, n - start)
                rows.append((doc, start, k, zlib.crc32(wide[4 * start : 4 * (start + k)]), n, seq, off, start + k < n, raw[size * start : size * (start + k)]))
                start += k
        types = (*[pa.int64()] * 7, pa.bool_(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[f.split()[0] for f in _PIECES.split(", ")])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for step in steps(batch, "ids"):
                yield pieces(step)

    placed = tokens.join(F.broadcast(offsets), "part").select((F.col("at") + F.col("before")).alias("at"), "doc_id", "doc_tokens", "ids")
    return placed.mapInArrow(cut, _PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, length): the pieces of each sequence put together; at most one sequence of ids per group."""
    joined = F.expr("aggregate(transform(array_sort(p), x -> x.ids), cast('' as binary), (a, x) -> concat(a, x))")
    return pieces.groupBy("sequence_id").agg(F.collect_list(F.struct("offset", "ids")).alias("p"), F.sum("length").alias("length")).select("sequence_id", joined.alias("ids"), "length")
