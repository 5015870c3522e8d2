"""Many fixed strings in many texts at once, and rules over texts and JSON as rows of a table. Ids G07, P34 of the survey."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the patterns that one automaton holds, and that one pass over the texts looks for.
SHARD_BYTES = 8 << 20


def _automaton(patterns: Sequence[tuple[int, str]]) -> Callable[[str], set[int]]:
    """A function from a text to the numbers of the patterns in it; the empty pattern is in every text."""
    always = {n for n, p in patterns if not p}
    rest = [(n, p) for n, p in patterns if p]
    try:
        import ahocorasick
    except ImportError:  # slower, the same result
        return lambda text: always | {n for n, p in rest if p in text}
    if not rest:
        return lambda text: always
    found = ahocorasick.Automaton()
    for n, p in rest:
        found.add_word(p, n)
    found.make_automaton()
    return lambda text: always.union(n for _, n in found.iter(text))


def _shards(patterns: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The different patterns (number, pattern) in shards of about ``most`` bytes, of which one is on the driver at a time."""
    size = F.octet_length("pattern") + F.lit(16)
    total = patterns.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    n = math.ceil(total / most)
    for k in range(n):
        rows = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == k) if n > 1 else patterns
        yield [(r.number, r.pattern) for r in rows.toLocalIterator()]


def numbered_patterns(patterns: DataFrame, column: str) -> DataFrame:
    """(number, pattern): the different patterns, by a hash of 64 bits."""
    one = patterns.select(F.col(column).alias("pattern")).where("pattern is not null").distinct()
    return one.select(F.xxhash64("pattern").alias("number"), "pattern")


def _scan(texts: DataFrame, shard: list[tuple[int, str]], key: str, merge: bool) -> DataFrame:
    """(number, key) of every find, or with ``merge`` (number, n, first) of each task's finds: texts and their smallest key."""
    name = texts.schema[key].dataType.simpleString()
    schema = f"number long, n long, first {name}" if merge else f"number long, key {name}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _automaton(shard)
        held: dict[int, list] = {}
        for batch in batches:
            numbers, keys = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n in find(text) if text is not None else ():
                    if merge:
                        at = held.setdefault(n, [0, None])
                        at[0] += 1
                        if k is not None and (at[1] is None or k < at[1]):
                            at[1] = k
                    else:
                        numbers.append(n)
                        keys.append(k)
            kind = batch.schema.field(0).type
            if not merge:
                yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(keys, kind)], names=["number", "key"])
        if held:
            columns = [pa.array(list(held), pa.int64()), pa.array([n for n, _ in held.values()], pa.int64()), pa.array([k for _, k in held.values()], kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["number", "n", "first"])

    return texts.mapInArrow(run, schema)


def _each_shard(texts: DataFrame, patterns: DataFrame, key: str, merge: bool, most: int) -> DataFrame:
    out = None
    for shard in _shards(patterns, most):
        found = _scan(texts, shard, key, merge)
        out = found if out is None else out.unionByName(found)
    return _scan(texts.limit(0), [], key, merge) if out is None else out


def matches(docs: DataFrame, patterns: DataFrame, key: str = "doc_id", text: str = "text", column: str = "pattern", most: int = SHARD_BYTES) -> DataFrame:
    """(key, pattern): the patterns that each text holds, once per row of ``docs``.

    All patterns of a shard are looked for in one pass over the texts by an Aho-Corasick automaton, which each task builds from
    its shard, at most about ``most`` bytes; more patterns take more passes. Null texts and patterns match nothing, the empty
    pattern every text.
    """
    named = numbered_patterns(patterns, column)
    found = _each_shard(docs.select(key, text), named, key, False, most)
    return found.join(named, "number").select(F.col("key").alias(key), F.col("pattern").alias(column))


def containment(docs: DataFrame, items: DataFrame, most: int = SHARD_BYTES) -> DataFrame:
    """(item_id, documents, first): how many documents hold an item's text anywhere in theirs, and the smallest doc_id of these.

    Items of any length, short ones too, are found as in ``matches``; each task sends one row per item that it found.
    Rows of ``items`` that share an id add up.
    """
    one = items.where("text is not null").groupBy("item_id", F.col("text").alias("pattern")).agg(F.count(F.lit(1)).alias("c"))
    found = _each_shard(docs.select("doc_id", "text"), numbered_patterns(items, "text"), "doc_id", True, most)
    found = found.groupBy("number").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    both = one.withColumn("number", F.xxhash64("pattern")).join(found, "number")
    return both.groupBy("item_id").agg(F.sum(F.col("c") * F.col("n")).alias("documents"), F.min("first").alias("first"))


def _holds(value: str, op: str, bound: str):
    """Whether a JSON value (text, null where there is none) passes a test; numbers compare as numbers."""
    x, y = F.col(value), F.col(bound)
    number = lambda c: c.try_cast("double")
    tests = {
        "exists": x.isNotNull(), "equals": x == y, "differs": x != y, "above": number(x) > number(y), "below": number(x) < number(y),
        "true": x == "true", "false": x == "false", "matches": F.expr(f"{value} rlike {bound}"),
    }
    out = F.lit(False)
    for name, ok in tests.items():
        out = F.when(F.col(op) == name, F.coalesce(ok, F.lit(False))).otherwise(out)
    return out


def evidence(texts: DataFrame, rules: DataFrame, key: str = "id") -> DataFrame:
    """(rule, source, key, decisive, line) of every text (source, key, text) that a rule holds for. G07.

    A rule is the rows of ``rules`` (rule, source, path, op, value, decisive) with its name, all of which have to hold for a text of
    its source: ``contains`` looks for ``value`` in the text, all of them by one automaton; other ops test the JSON value at ``path``:
    exists, equals, differs, above, below, true, false, matches (a pattern). Texts that aren't JSON have no values. ``decisive`` is the
    largest of a rule's rows; line is that of the first find of the rule's smallest contained string, null for rules without one.
    Rules are rows of a table of any number of kinds but small: their strings follow the bounds of ``matches``. Equal conditions
    of a rule count once. Keys are unique within a source.
    """
    c = rules.groupBy("rule", "source", "path", "op", "value").agg(F.max("decisive").alias("decisive"))
    wanted = c.groupBy("rule", "source").agg(F.count(F.lit(1)).alias("_all"), F.max("decisive").alias("decisive"))
    held = texts.select("source", F.col(key).alias("_key"), "text")
    # strings: one scan of the texts for those of all rules
    strings = c.where("op = 'contains'").select("rule", "source", "value")
    hits = matches(held.select(F.struct("source", "_key").alias("_at"), "text"), strings, "_at", "text", "value")
    hits = hits.select("_at.source", "_at._key", "value").join(strings, ["source", "value"])
    found = hits.select("rule", "source", "_key", F.col("value").alias("_string"))
    # values: the conditions on a source are few, each is tested where the text is
    values = c.where("op <> 'contains'").select("rule", "source", "path", "op", "value")
    tested = held.join(F.broadcast(values), "source").withColumn("_value", F.expr("get_json_object(text, path)")).where(_holds("_value", "op", "value"))
    found = found.unionByName(tested.select("rule", "source", "_key", F.lit(None).cast("string").alias("_string")))
    met = found.groupBy("rule", "source", "_key").agg(F.count(F.lit(1)).alias("_met"), F.min("_string").alias("_string"))
    met = met.join(wanted, ["rule", "source"]).where("_met = _all")
    lined = met.join(held, ["source", "_key"])
    before = F.expr("substring(text, 1, locate(_string, text) - 1)")
    line = F.when(F.col("_string").isNotNull(), F.size(F.split(before, "\n", -1)))
    return lined.select("rule", "source", F.col("_key").alias(key), "decisive", line.alias("line"))
