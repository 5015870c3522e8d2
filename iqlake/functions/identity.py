"""Stable ids, coordinates, keys and digests. Ids P01-P08, H02-H05, W02 of the survey."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sample_id(dataset: str, modulation: Column, snr: Column, index: Column, style: str = "%s") -> Column:
    """``dataset:modulation:+00:0000``; style ``%02d`` for numbered modulations. P01, P02."""
    return F.format_string(f"{dataset}:{style}:%+03d:%04d", modulation, snr, index)


def parse_sample_id(sid: Column) -> Column:
    """struct(dataset, modulation, snr, index, canonical): canonical where formatting the parts gives the id back. P03."""
    parts = F.split(sid, ":")
    part = lambda i: F.try_element_at(parts, F.lit(i))
    snr, index = part(3).try_cast("int"), part(4).try_cast("int")
    again = F.concat_ws(":", part(1), part(2), F.format_string("%+03d:%04d", snr, index))
    canonical = F.coalesce((F.size(parts) == 4) & (index >= 0) & (again == sid), F.lit(False))
    return F.struct(part(1).alias("dataset"), part(2).alias("modulation"), snr.alias("snr"), index.alias("index"), canonical.alias("canonical"))


def row_index(m: Column, s: Column, i: Column, n_snr: int, per_cell: int) -> Column:
    """Row of a sample in a table sorted by (modulation, SNR, index) with full cells. P04."""
    return ((m * n_snr + s) * per_cell + i).cast("long")


def coordinates(row: Column, n_snr: int, per_cell: int, beyond: Column | None = None) -> Column:
    """struct(m, s, i): the inverse of ``row_index``. P05.

    An index of ``per_cell`` or more reaches into the rows of later cells. ``beyond`` is its number of whole cells, index div
    ``per_cell``, which the row by itself doesn't tell; without it every index is taken to be below ``per_cell``.
    """
    more = F.lit(0).cast("long") if beyond is None else beyond * per_cell
    own = row - more
    place = F.pmod(own, F.lit(per_cell))
    cell = F.floor((own - place) / per_cell).cast("long")
    s = F.pmod(cell, F.lit(n_snr))
    return F.struct(F.floor((cell - s) / n_snr).cast("int").alias("m"), s.cast("int").alias("s"), (place + more).cast("int").alias("i"))


def snr_key(snr: Column) -> Column:
    """``+0``, ``-10``: the level as a map key. P06."""
    return F.format_string("%+d", snr)


def parse_snr_key(key: Column) -> Column:
    """The level of a key, null where the key isn't written as ``snr_key`` writes it. P07."""
    value = key.try_cast("int")
    return F.when(snr_key(value) == key, value)


def float_id(x: Column) -> Column:
    """A decimal number's text with ``p`` for the point, exponents spelled out. P08."""
    text = F.regexp_replace(F.regexp_replace(x.cast("decimal(20,10)").cast("string"), "0+$", ""), r"\.$", "")
    return F.replace(text, F.lit("."), F.lit("p"))


def framed(*parts: Column) -> Column:
    """Each text's bytes after their number as 8 big-endian bytes, all in a row."""
    out = []
    for p in parts:
        raw = F.encode(p, "utf-8")
        out += [F.unhex(F.lpad(F.hex(F.octet_length(raw).cast("long")), 16, "0")), raw]
    return F.concat(*out)


def rank_digest(domain: str, seed: str, sid: Column) -> Column:
    """SHA-256 over the framed domain, seed and id; sorting its hex text sorts its bytes. W02."""
    return F.sha2(framed(F.lit(domain), F.lit(seed), sid), 256)


def bytes_of(n: Column) -> Column:
    """A number as 8 big-endian bytes."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def _in_order(entries: Column) -> Column:
    """SHA-256 of the last field's bytes of an array of structs, in the order of the others."""
    return F.sha2(_joined(F.array_sort(entries)), 256)


def _joined(entries: Column) -> Column:
    """The raw bytes of all entries in a row."""
    return F.unhex(F.array_join(F.transform(entries, lambda x: F.hex(x["raw"])), ""))


def content_digest(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., digest) over the records (ord, name, dtype, shape, sha256) of each group's columns, in the order of ord: framed name
    and type, number of dimensions, dimensions, content digest. There are as many records as columns. H04."""
    shape = F.aggregate("shape", F.lit(b""), lambda a, n: F.concat(a, bytes_of(n)))
    raw = F.concat(framed(F.col("name"), F.col("dtype")), bytes_of(F.size("shape")), shape, F.unhex("sha256"))
    return rows.groupBy(*by).agg(_in_order(F.collect_list(F.struct("ord", raw.alias("raw")))).alias("digest"))


def source_digest(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., digest) over cells (modulation, snr_db, sha256), sorted: name, level and digest with zero bytes between. There are as
    many cells as the grid has. H05."""
    zero = F.lit(b"\0")
    raw = F.concat(F.encode("modulation", "utf-8"), zero, F.encode(F.col("snr_db").cast("string"), "utf-8"), zero, F.unhex("sha256"))
    return cells.groupBy(*by).agg(_in_order(F.collect_list(F.struct("modulation", "snr_db", raw.alias("raw")))).alias("digest"))


def row_digest(row: Column) -> Column:
    """SHA-256 of a struct's JSON as UTF-8; its fields should be in the order of their names. H03 for rows."""
    return F.sha2(F.encode(F.to_json(row, {"ignoreNullFields": "false"}), "utf-8"), 256)


def json_digest(value: Any, ascii_only: bool = True) -> str:
    """SHA-256 of the value's JSON with sorted keys and no blanks; the two forms differ beyond ASCII. H02, H03."""
    text = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=ascii_only)
    return hashlib.sha256(text.encode()).hexdigest()
