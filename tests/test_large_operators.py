"""Operators for tables of any size, against plain restatements: window pairs, ordered digests, patterns, rules, keyed streams."""

import hashlib
import json

import numpy as np
import pytest

from iqlake.functions.sha256 import Sha256
from iqlake.operators import digests, patterns, progress, skyline, windows
from iqlake.sources import archives, leases, ordered_tables
from iqlake.streaming import patience
from iqlake.streaming.progress import event_stream


def correlation(a, b):
    x, y = np.fft.fft(a), np.fft.fft(b)
    return min(1.0, np.abs(np.fft.ifft(x * np.conj(y))).max() / (np.linalg.norm(a) * np.linalg.norm(b)))


@pytest.mark.parametrize(("least", "cell"), [(0.999, 2048), (0.999, 16), (0.99, 8), (0.9999999, 12), (0.7, 40)])
def test_near_pairs(spark, least, cell):
    """Shifted, scaled and turned copies with a little noise are found, whatever the cells are."""
    rng = np.random.default_rng(7)
    base = [rng.normal(size=16) + 1j * rng.normal(size=16) for _ in range(90)]
    near = [np.roll(base[k % 20], int(rng.integers(16))) * rng.uniform(0.1, 9) * np.exp(1j * rng.uniform(0, 6)) + rng.normal(size=16) * 10.0 ** -rng.integers(1, 6) for k in range(60)]
    crowd = [base[0] + rng.normal(size=16) * 1e-3 for _ in range(40)]
    all_of = [(i, *(np.float32(p).astype(float).tolist() for p in (w.real, w.imag))) for i, w in enumerate([*base, *near, *crowd])]
    odd = [(2000, None, [1.0] * 16), (2001, [0.0] * 16, [0.0] * 16), (2002, [float("nan")] * 16, [1.0] * 16), (2003, [], []), (2004, [1.0] * 8, [2.0] * 8), (2005, [2.0] * 8, [4.0] * 8), (2006, [1.0], [2.0, 3.0])]
    copies = [(1000 + k, *all_of[i][1:]) for k, i in enumerate((0, 0, 5))]
    df = spark.createDataFrame(all_of + copies + odd, "vec_id long, i array<float>, q array<float>").repartition(5)
    got = {(r.left, r.right): r.score for r in windows.near_pairs(df, "vec_id", least, cell).collect()}
    z = [np.array(i) + 1j * np.array(q) for _, i, q in all_of]
    want = {(a, b): s for b in range(len(z)) for a in range(b) if (s := correlation(z[a], z[b])) >= least} | {(2004, 2005): 1.0}
    edge = {p for p in set(got) ^ set(want) if p[0] < 2000 and abs(correlation(z[p[0]], z[p[1]]) - least) < 1e-12}
    assert set(got) - edge == set(want) - edge and len(want) > 30
    assert all(abs(got[p] - want[p]) < 1e-9 for p in set(got) & set(want))
    assert {r.vec_id: r.representative for r in windows.classes(df.where("vec_id < 2000")).where("vec_id <> representative").collect()} == {1000: 0, 1001: 0, 1002: 5}


def test_near_pairs_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, i array<float>, q array<float>")
    assert windows.near_pairs(df).count() == 0


def test_sha256_can_be_taken_up_again(monkeypatch):
    rng = np.random.default_rng(3)
    for native in (True, False):
        if not native:
            monkeypatch.setattr("iqlake.functions.sha256._native", lambda: None)
        for n in (0, 1, 55, 56, 63, 64, 65, 119, 1000):
            data, at, d = rng.bytes(n), 0, Sha256()
            while at < n:
                k = int(rng.integers(1, 150))
                d, at = Sha256(d.state()).update(data[at : at + k]), at + k
            assert d.hexdigest() == hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("per", [1 << 22, 60])
def test_assignment_digest(spark, per):
    """The digest is hashlib's over all bytes in one run, however many ranges the keys lie in."""
    rng = np.random.default_rng(5)
    keys = {"train": rng.permutation(300) * 7 - 5, "validation": np.array([], int), "test": rng.integers(-(2**62), 2**62, 40)}
    h = hashlib.sha256()
    for s in ("train", "validation", "test"):
        raw = np.sort(keys[s]).astype("<i8")
        h.update(len(s).to_bytes(8, "big") + s.encode() + len(raw).to_bytes(8, "big") + raw.tobytes())
    rows = [(int(k), s) for s, ks in keys.items() for k in ks] + [(3, "other")]
    got = digests.assignment_digest(spark.createDataFrame(rows, "key long, split string").repartition(4), "key", per=per).collect()
    assert [tuple(r) for r in got] == [(340, h.hexdigest())]
    with pytest.raises(ValueError):
        digests.assignment_digest(spark.createDataFrame([(None, "test")], "key long, split string"), "key")


@pytest.mark.parametrize("per", [1 << 22, 90])
def test_group_digests(spark, per):
    """Groups within a range, groups over several, null groups, floats, texts and numbers."""
    rng = np.random.default_rng(6)
    rows = [(("a", "b", None, "c")[min(3, k % 9)], int(o), rng.normal(size=3).astype(np.float32).tolist(), f"é{k}") for k, o in enumerate(rng.permutation(300))]
    df = spark.createDataFrame(rows, "g string, o long, x array<float>, t string").repartition(6)
    for raw, to_bytes in (("x", lambda r: np.array(r[2], "<f4").tobytes()), ("t", lambda r: r[3].encode()), ("o", lambda r: np.array([r[1]], "<i8").tobytes())):
        want = {}
        for g in ("a", "b", None, "c"):
            mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[1])
            want[g] = (len(mine), hashlib.sha256(b"".join(map(to_bytes, mine))).hexdigest())
        got = digests.group_digests(df, ["g"], ["o"], raw, per).collect()
        assert {r.g: (r.n, r.digest) for r in got} == want and len(got) == 4
    assert digests.group_digests(df.limit(0), ["g"], ["o"], "x").count() == 0


@pytest.mark.parametrize(("most", "library"), [(patterns.SHARD_BYTES, True), (40, True), (patterns.SHARD_BYTES, False)])
def test_patterns(spark, monkeypatch, most, library):
    if not library:
        monkeypatch.setitem(__import__("sys").modules, "ahocorasick", None)
    texts = [(1, "the cat sat on the mat"), (2, "cat"), (3, ""), (4, None), (5, "über cats 日本 a\nb"), (5, "über"), (None, "mat mat"), (7, "aaaa")]
    items = [(10, "cat"), (11, "at"), (12, "über"), (13, ""), (14, None), (15, "a b"), (16, "日本"), (17, "aaa"), (18, "cat"), (10, "mat"), (10, "mat"), (19, "the cat sat on the mat")]
    docs = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, pattern string").repartition(3)
    named = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.pattern) for r in patterns.matches(docs, named.withColumnRenamed("text", "pattern"), most=most).collect())
    assert got == sorted((str(d), p) for d, t in texts if t is not None for p in {p for _, p in items if p is not None} if p in t)
    want = {}
    for i in {i for i, _ in items}:
        hits = [d for j, p in items if j == i and p is not None for d, t in texts if t is not None and p in t]
        if hits:
            want[i] = (len(hits), min(d for d in hits if d is not None) if any(d is not None for d in hits) else None)
    assert {r.item_id: (r.documents, r["first"]) for r in patterns.containment(docs, named, most=most).collect()} == want
    assert patterns.containment(docs, named.limit(0)).count() == patterns.containment(docs.limit(0), named).count() == 0


def test_rules_are_rows(spark):
    texts = [("json", 1, '{"a": {"n": 5, "ok": true}, "s": "x1"}'), ("json", 2, '{"a": {"n": 50}, "s": "y"}'), ("json", 3, "not json"), ("json", 4, None), ("text", 1, "one\ntwo needle\nhay"), ("text", 2, "needle")]
    rules = [
        ("big", "json", "$.a.n", "above", "9", True), ("small_ok", "json", "$.a.n", "below", "9", False), ("small_ok", "json", "$.a.ok", "true", None, False), ("named", "json", "$.s", "matches", "^x[0-9]$", False),
        ("is", "json", "$.s", "equals", "y", False), ("isnt", "json", "$.s", "differs", "y", False), ("has", "json", "$.a", "exists", None, False), ("off", "json", "$.a.ok", "false", None, True),
        ("odd", "json", "$.a", "unknown op", "1", True), ("found", "text", None, "contains", "needle", True), ("all", "text", None, "contains", "needle", False), ("all", "text", None, "contains", "hay", False), ("all", "text", None, "contains", "hay", False),
        ("mixed", "json", "$.a.n", "above", "1", False), ("mixed", "json", None, "contains", "x1", True),
    ]
    got = patterns.evidence(spark.createDataFrame(texts, "source string, id long, text string"), spark.createDataFrame(rules, "rule string, source string, path string, op string, value string, decisive boolean")).collect()
    assert sorted((r["rule"], r.id, r.decisive, r.line) for r in got) == sorted([
        ("big", 2, True, None), ("small_ok", 1, False, None), ("named", 1, False, None), ("is", 2, False, None), ("isnt", 1, False, None), ("has", 1, False, None), ("has", 2, False, None),
        ("found", 1, True, 2), ("found", 2, True, 1), ("all", 1, False, 3), ("mixed", 1, True, 1),
    ], key=str)


def test_patience_folds_any_cut(spark):
    rng = np.random.default_rng(8)
    for _ in range(200):
        x = rng.normal(size=rng.integers(1, 80)).round(1)
        x[rng.random(len(x)) < 0.1] = np.nan
        whole = progress.Patience().fold(x, 0.2, 7)
        best, at, stale, stop = -np.inf, 0, 0, 0
        for i, v in enumerate(x, 1):
            if v > best + 0.2:
                best, at, stale = v, i, 0
            else:
                stale += 1
                if stale >= 7:
                    stop = i
                    break
        assert (whole.best, whole.best_at, whole.stale, whole.stopped_at, whole.seen) == (best, at, stale, stop, len(x))
        cut = progress.Patience()
        for part in np.split(x, sorted(rng.integers(0, len(x) + 1, 3))):
            cut.fold(part, 0.2, 7)
        assert cut == whole


def test_streaming_patience_goes_on_after_a_restart(spark, tmp_path):
    """Two calls over a growing log give what one fold over all of it gives, and no epoch counts twice."""
    rng = np.random.default_rng(9)
    rows = [(f"m{k % 3}", k % 2, t, float(rng.normal())) for t in range(120) for k in range(6)] + [("late", 0, 200, None)]
    log, folder = f"file://{tmp_path}/log", f"file://{tmp_path}/run"
    schema = "model string, seed int, at int, score double"

    def put(part):
        spark.createDataFrame(part, schema).repartition(1).write.mode("append").parquet(log)

    def follow():
        return patience.follow(event_stream(spark, log, files_per_trigger=1), folder, ["model", "seed"], ["at"], "score", 0.3, 15)

    order = sorted(rows, key=lambda r: r[2])
    for a, b in ((0, 250), (250, 251)):
        part = order[a:b]
        rng.shuffle(part)
        put([(m, int(s), int(t), None if x is None else float(x)) for m, s, t, x in part])
    first = {(r.model, r.seed): r.seen for r in follow().collect()}
    assert sum(first.values()) == 251
    put(order[251:])
    got = {(r.model, r.seed): tuple(r)[2:6] for r in follow().collect()}
    want = progress.patience(spark.createDataFrame(rows, schema), ["model", "seed"], ["at"], "score", 0.3, 15).collect()
    assert got == {(r.model, r.seed): tuple(r)[2:] for r in want} and len(got) == 7
    again = {(r.model, r.seed): r.seen for r in follow().collect()}
    assert sum(again.values()) == len(rows)


def test_rules_and_patterns_need_no_json(spark):
    t = spark.createDataFrame([("s", 1, json.dumps({"a": 1}))], "source string, id long, text string")
    r = spark.createDataFrame([], "rule string, source string, path string, op string, value string, decisive boolean")
    assert patterns.evidence(t, r).count() == 0


@pytest.mark.parametrize(("block", "strong"), [(4096, 512), (8, 3)])
def test_front(spark, monkeypatch, block, strong):
    monkeypatch.setattr(skyline, "BLOCK", block)
    monkeypatch.setattr(skyline, "STRONG", strong)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (400, 3)).astype(float)
    x[:, 2] = x[:, 0] + x[:, 1] + rng.integers(0, 3, 400)  # many that don't dominate each other
    rows = [(i, *map(float, p)) for i, p in enumerate(x)] + [(900, None, 0.0, 99.0), (901, float("nan"), 0.0, 99.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(5)
    best = {i for i, a, b, c in rows[:400] if not any(p <= a and q <= b and r >= c and (p < a or q < b or r > c) for _, p, q, r in rows[:400])}
    assert {r.id for r in skyline.front(df, ["a", "b"], ["c"]).collect()} == best and len(best) > 10
    assert skyline.front(df.limit(0), ["a"], ["c"]).count() == 0


def test_ordered_tables(spark, tmp_path):
    rows = spark.createDataFrame([((i * 7) % 50, None if i % 9 == 0 else f"k{i % 4}", i) for i in range(300)], "a long, b string, i int").repartition(4)
    path = f"file://{tmp_path}/t"
    ordered_tables.write_ordered(rows, path, ["b", "a", "i"], per=40)
    assert ordered_tables.out_of_order(spark, path).count() == 0
    got = [r.i for r in ordered_tables.numbered_in_order(spark, path).orderBy("position").collect()]
    assert got == [r.i for r in rows.orderBy("b", "a", "i").collect()]
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        ordered_tables.write_ordered(rows, path, ["a"])
    bad = f"file://{tmp_path}/bad"
    rows.coalesce(1).withColumn("_range", (rows.i % 3).cast("int")).sortWithinPartitions("_range").write.partitionBy("_range").parquet(bad)
    with pytest.raises(FileNotFoundError):
        ordered_tables.read_ordered(spark, bad)
    from iqlake.sources.sinks import create_once

    create_once(spark, f"{bad}.order.json", json.dumps({"order": ["a"], "columns": ["a", "b", "i"]}))
    found = {(r.range, r.place) for r in ordered_tables.out_of_order(spark, bad).collect()}
    assert found and (1, 0) in found and (2, 0) in found


def test_tar_source(spark, tmp_path):
    import io
    import tarfile

    names = ["a.txt", "dir/b.txt", "../up.txt", "/abs.txt"]
    for k, mode in enumerate(("w", "w:gz", "w:bz2")):
        with tarfile.open(tmp_path / f"x{k}.tar", mode) as tar:
            for n in names:
                info = tarfile.TarInfo(n)
                info.size = k * 700_000
                tar.addfile(info, io.BytesIO(b"z" * info.size))
            link = tarfile.TarInfo("link")
            link.type, link.linkname = tarfile.SYMTYPE, "a.txt"
            tar.addfile(link)
    root = f"file://{tmp_path}"
    got = archives.tar_members(spark, root, pathGlobFilter="*.tar").collect()
    assert sorted((r.path[-6:], r.member, r.size, r.kind, r.safe) for r in got) == sorted((f"x{k}.tar", n, size, kind, n in names[:2]) for k in range(3) for n, size, kind in [*((n, k * 700_000, "file") for n in names), ("link", 0, "other")])
    assert {r.sha256 for r in got if r.member == "a.txt"} == {hashlib.sha256(b"z" * 700_000 * k).hexdigest() for k in range(3)}
    one = archives.tar_members(spark, root, pathGlobFilter="*.tar").where("member = 'a.txt'").where(f"path = 'file:{tmp_path}/x1.tar'")
    assert one.rdd.getNumPartitions() == 1 and [(r.member, r.size) for r in one.collect()] == [("a.txt", 700_000)]
    assert {r.path[-6:]: (r.members, r.bytes, r.safe) for r in archives.archive_inventory(archives.tar_members(spark, root, digests=False)).collect()} == {f"x{k}.tar": (5, 4 * 700_000 * k, False) for k in range(3)}
    assert archives.tar_members(spark, root, pathGlobFilter="*.none").count() == 0
    with pytest.raises(Exception, match="more members"):
        archives.tar_members(spark, root, members=3).count()


def test_written_archives_hold_every_row(spark, tmp_path):
    rows = [(f"d/{i}", bytes([i % 256]) * i) for i in range(150)] + [("d/none", None)]
    written = archives.write_archives(spark.createDataFrame(rows, "member string, content binary").repartition(3), f"file://{tmp_path}/a", members=20)
    got = archives.tar_members(spark, f"file://{tmp_path}/a", pathGlobFilter="*.bz2").collect()
    assert sorted((r.member, r.sha256) for r in got) == sorted((m, hashlib.sha256(c or b"").hexdigest()) for m, c in rows)
    assert sum(r.members for r in written.collect()) == 151 and max(r.members for r in written.collect()) == 20
    assert not [p for p in (tmp_path / "a").iterdir() if p.name.startswith(".") and p.name.endswith(".bz2")]


def test_small_archives_share_partitions(spark, tmp_path):
    rows = [(f"d/{i}", bytes([i % 256]) * i) for i in range(90)]
    archives.write_archives(spark.createDataFrame(rows, "member string, content binary").repartition(3), f"file://{tmp_path}/a", members=2)
    read = lambda **options: archives.tar_members(spark, f"file://{tmp_path}/a", pathGlobFilter="*.bz2", **options)
    assert len({r.path for r in read().collect()}) >= 45
    for options, least, most in (({}, 4, 5), ({"parallelism": 10}, 10, 12), ({"partitionBytes": 4 * archives.OPENING + 4096}, 11, 15), ({"partitionBytes": 1}, 45, 48)):
        got = read(**options)
        assert least <= got.rdd.getNumPartitions() <= most
        assert sorted((r.member, r.sha256) for r in got.collect()) == sorted((m, hashlib.sha256(c).hexdigest()) for m, c in rows)


def test_leases_fence_off_late_writers(spark, tmp_path):
    path, rows = f"file://{tmp_path}/table", spark.range(3)
    assert leases.published(spark, path) is None
    dead = leases.acquire(spark, path, "dead", seconds=0.0)  # has run out at once
    late = leases.acquire(spark, path, "late", seconds=0.0)
    with pytest.raises(leases.LeaseLost):
        dead.publish(rows)
    now = leases.acquire(spark, path, "now", seconds=600)
    with pytest.raises(FileExistsError):
        leases.acquire(spark, path, "other")
    rows.write.parquet(late.data)  # had written everything but the manifest
    with pytest.raises(leases.LeaseLost):
        late.publish(rows)
    assert leases.published(spark, path) is None
    now.publish(rows)
    now.release()
    assert leases.published(spark, path).count() == 3
    after = leases.acquire(spark, path, "after")
    assert [x.token for x in (dead, late, now, after)] == [1, 2, 3, 4] and leases.published(spark, path).count() == 3
    after.publish(spark.range(5))
    assert leases.published(spark, path).count() == 5
