"""Importance resampling against a plain restatement, and odd inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from iqlake.llm import importance, queries, sql
from tests.parity import connect, same

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def brute(docs, target):
    raw, aim = Counter(), Counter()
    for _, t in docs:
        raw.update(buckets(t)[0])
    for t in target:
        aim.update(buckets(t)[0])
    all_s, all_t = sum(raw.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000)))) for b, s in raw.items()}
    rows = []
    for doc, text in docs:
        found, words = buckets(text)
        h = int(hashlib.sha256(f"42:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1], -r[2]))
    rank = {id(r): k for k, r in enumerate(able[: 5 * len(able) // 100], 1)}
    return sorted((tuple(r[:4]) + (rank.get(id(r)),) for r in rows), key=repr)


ODD = [(1, None), (2, ""), (3, " .,- \n"), (4, "one"), (5, "Ünï Ünï ΣΑΣ İx ſK"), (6, "a" * 100_000), (7, "x " * 50_000), (None, "the cat sat " * 20), (8, "the cat sat " * 20), (8, "the cat sat " * 20), (9, "tab\tand\x00nul\x7fdel ~ 日本語 😀x 4you" * 9)]


@pytest.mark.parametrize("parts", [1, 7])
def test_importance(spark, parts):
    docs = ODD + [(100 + i, " ".join(f"w{(i * j) % 37}" for j in range(5 + i % 60))) for i in range(300)]
    target = [None, "", "the cat w1 w2 w3", "w5 w10 w15"]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, word string, bucket int").repartition(parts)
    aim = spark.createDataFrame([(0, t, "y") for t in target], "item_id int, text string, doc_id string")
    got = sorted((tuple(r) for r in importance.resample(df, aim).collect()), key=repr)
    assert got == brute(docs, target)
    assert sum(r[4] is not None for r in got) == 5 * sum(buckets(t)[1] >= 20 for _, t in docs) // 100 > 0


def test_ranks_go_through_ties_and_ranges(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1000).select((F.col("id") % 3).alias("a"), F.col("id").alias("row")).repartition(5)
    got = importance.ranked(rows, F.desc("a"), F.asc("row")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001))
    assert [(r["a"], r["row"]) for r in got] == sorted(((i % 3, i) for i in range(1000)), key=lambda e: (-e[0], e[1]))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    full = spark.createDataFrame([(1, "a b c " * 30)], docs.schema)
    assert importance.resample(docs, full).count() == 0
    r = importance.resample(full, docs).collect()
    assert [(x.n_features, x["rank"]) for x in r] == [(267, None)]


def test_query_gives_the_rows_of_its_sql(spark, sf_dir):
    same(queries.op11_importance(spark, sf_dir), connect(sf_dir), sql.IMPORTANCE)
