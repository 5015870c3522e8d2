"""Packing, archives, sharding, chat rendering and vectors: round trips, SQL and brute force; odd inputs."""

import gzip
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from iqlake.llm import archive, chat, embeddings, packing, queries, sharding
from tests.llm import brute
from tests.parity import connect, same

public = pytest.importorskip("public_tokenizers")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public.path("byte_bpe_50k.json"))


TEXTS = ["Hello, world!", None, "", "it's  12 ab3\t\t x　y <|endoftext|> \r\n", "Ünï " * 3000, "a\n\n b  c", "日本語 text 😀" * 40, "same", "same"]


def test_encoder_gives_the_files_ids(sf_dir, spark):
    texts = [t or "" for t in TEXTS] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    encode = packing.encoder(public.path("byte_bpe_50k.json"))
    assert [encode(t) for t in texts] == [e.ids for e in tokenizer().encode_batch(texts, add_special_tokens=False)]


def test_packing(spark):
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string").repartition(3)
    pieces = packing.pack(docs, public.path("byte_bpe_50k.json"), sequence=64).cache()
    rows = pieces.collect()
    for i, t in enumerate(TEXTS):
        want = [*tokenizer().encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted((r.start, r) for r in rows if r.doc_id == i)
        assert [x for _, r in mine for x in np.frombuffer(r.ids, np.uint16).tolist()] == want
        for start, r in mine:
            assert r.length == len(r.ids) // 2 and r.doc_tokens == len(want) and r.boundary == (start + r.length < len(want))
            assert r.ids_crc32 == zlib.crc32(np.array(want[start : start + r.length], "<u4").tobytes())
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, spans in by_seq.items():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at == 64 or s == len(by_seq) - 1
    assert {r.sequence_id: r.length for r in packing.sequences(pieces).collect()} == {s: sum(n for _, n in v) for s, v in by_seq.items()}
    assert packing.pack(spark.createDataFrame([], docs.schema), public.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("blank", [" ", "\t", "\r\n", " \n", "mixed"])
def test_long_white_space(blank):
    run = "".join(random.Random(1).choices(" \t\n\r\u2003", k=1_000_000)) if blank == "mixed" else (blank * 1_000_000)[:1_000_000]
    for text, added in ((run, True), (f"x{run}a<|endoftext|>{run[:9]}", blank != " ")):
        plain = tokenizer()
        plain.encode_special_tokens = not added
        assert packing.encoder(public.path("byte_bpe_50k.json"), added)(text) == plain.encode(text, add_special_tokens=False).ids


def test_ids_of_large_vocabularies(spark, tmp_path):
    import json

    file = json.loads(open(public.path("byte_bpe_50k.json"), encoding="utf-8").read())
    file["added_tokens"].append({"id": 70_000, "content": "<|far|>", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
    (tmp_path / "t.json").write_text(json.dumps(file), encoding="utf-8")
    docs = spark.createDataFrame([(1, "a<|far|>b")], "doc_id long, text string")
    r = packing.pack(docs, str(tmp_path / "t.json")).collect()[0]
    assert np.frombuffer(r.ids, "<u4").tolist() == [64, 70_000, 65, 1] and r.ids_crc32 == zlib.crc32(np.array([64, 70_000, 65, 1], "<u4").tobytes())


def test_queries_give_the_ids_of_the_unmodified_file(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline

    plain = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", *(t for t in TEXTS if t)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, 1]
    got = queries.op2_packing(spark, str(tmp_path)).where("start = 0 and not boundary").collect()
    assert len(got) >= 3
    for r in got:
        assert (r.doc_tokens, r.ids_crc32) == (len(want[r.doc_id]), zlib.crc32(np.array(want[r.doc_id], "<u4").tobytes()))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.doc_tokens for r in corpus_pipeline.pack(spark, docs, str(tmp_path)).collect()} == {i: len(w) for i, w in want.items()}


def test_archive_round_trip(spark, tmp_path):
    long = "x" * 200
    pages = [(1, "http://a/ b", "<p>é</p>"), (2, None, None), (5, "http://c", long), (3, "http://d", long), (9, "dns:x", long + "\r\n\r\nWARC/1.1"), (10, "http://e", ""), (11, "http://f", "short"), (12, "http://g", "short"), (None, "http://h", long)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2)
    archive.write_arc(df.where("page_id % 2 = 1 or page_id is null"), f"{tmp_path}/arc/1", 1)
    archive.write_arc(df.where("page_id % 2 = 0"), f"{tmp_path}/arc/2", 2)
    arc = archive.read_arc(spark, f"{tmp_path}/arc")
    assert {(r.source_id, bytes(r.payload).decode()) for r in arc.collect()} == {(p, h or "") for p, _, h in pages}
    assert {r.version for r in arc.collect()} == {1, 2}
    archive.convert(arc, f"{tmp_path}/warc")
    got = {r.page_id: r for r in archive.read_warc(spark, f"{tmp_path}/warc").collect()}
    for p, _, h in pages:
        raw = (h or "").encode()
        assert (got[p].payload_bytes, got[p].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
    assert [(p, got[p].record_type, got[p].refers_to) for p in (3, 5, None, 11, 12)] == [(3, "response", None), (5, "revisit", 3), (None, "revisit", 3), (11, "response", None), (12, "response", None)]
    assert got[1].warc_date == "2008-04-30T20:48:25Z" and got[1].target_uri == "http://a/%20b"


def test_archives_of_other_encodings(spark, tmp_path):
    http = b"HTTP/1.0 200 OK\r\nX-Note: caf\xe9\r\n\r\n"
    body = bytes(range(256)) + b"\r\n\r\nx"
    url = b"http://h/\xe9\xff/\xc3\xa9"
    record = url + b" 1.2.3.4 20080101000000 text/html %d\n" % len(http + body) + http + body + b"\n"
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "old.arc").write_bytes(b"filedesc://x 0.0.0.0 2008 text/plain 9\n1 0 test\n\n" + record)
    arc = archive.read_arc(spark, f"{tmp_path}/a")
    r = arc.collect()[0]
    assert (r.record_url, bytes(r.http), bytes(r.payload)) == ("http://h/%E9%FF/é", http, body)
    archive.convert(arc, f"{tmp_path}/w")
    blocks = [b for p in (tmp_path / "w").glob("*.gz") for h, b in archive.warc_records(gzip.decompress(p.read_bytes())) if h["warc-type"] == "response"]
    assert blocks == [http + body]
    got = archive.read_warc(spark, f"{tmp_path}/w").collect()
    assert [(r.target_uri, r.payload_digest) for r in got] == [("http://h/%E9%FF/é", hashlib.sha256(body).hexdigest())]


@pytest.mark.parametrize("share", [1 / 1024, 1.0])
def test_archives_with_common_payloads(spark, tmp_path, monkeypatch, share):
    monkeypatch.setattr(archive, "HOT_SHARE", share)
    monkeypatch.setattr(archive, "FILE_BYTES", 4000)
    rng = random.Random(2)
    pages = [(i, f"http://x/{i % 50}", rng.choice(["a" * 150, "b" * 150, "", "short", f"{i}" * 60])) for i in range(400)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    same(queries.op4_warc(spark, str(tmp_path)), con, queries.oracle_sql()["op4_warc"])


def test_archive_of_no_pages(spark, tmp_path):
    archive.write_arc(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/a")
    archive.convert(archive.read_arc(spark, f"{tmp_path}/a"), f"{tmp_path}/w")
    assert archive.read_warc(spark, f"{tmp_path}/w").count() == 0


def test_broken_archives_raise():
    good = b"filedesc://x 0.0.0.0 2008 text/plain 9\n1 0 test\n\nhttp://a 1.2.3.4 20080101000000 text/plain 2\nhi\n"
    assert [(v, f["URL"], b) for v, f, b in archive.arc_records(good)] == [(1, "http://a", b"hi")]
    for bad in (good[:-3], good.replace(b"plain 2", b"plain x"), good.replace(b" 2008 text/plain 9\n1 0", b" 2008 text/plain 9\n2 0")):
        with pytest.raises(ValueError):
            list(archive.arc_records(bad))


@pytest.mark.parametrize("limit", [50, 4000, 10**9])
def test_sharding(spark, limit):
    rng = random.Random(5)
    rows = [(i, "é" * rng.randrange(40), "k") for i in range(600)] + [(7, "same"), (7, "same"), (601, None), (None, "x"), (602, "y" * 5000)]
    rows = [(r[0], r[1], "k") for r in rows] + [(8, "z" * 20, "k")] * 200
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, bytes string"), limit).collect()
    assert len(got) == len(rows)
    shards, prefixes = {}, {}
    for r in got:
        shards.setdefault((r.depth, r.prefix, r.part), []).append(r)
        prefixes.setdefault(r.depth, set()).add(r.prefix)
    for rs in shards.values():
        total = sum(r.bytes for r in rs)
        assert all(r.shard_bytes == total and r.shard_rows == len(rs) for r in rs)
        assert total <= limit or len(rs) == 1
    for d, ps in prefixes.items():  # no bucket lies within another, and a bucket was split only where it had to be
        assert not any(p >> (d - e) in qs for e, qs in prefixes.items() if e < d for p in ps)
        for p in ps if d else ():
            under = sum(r.bytes for r in got if r.depth >= d - 1 and r.prefix >> (r.depth - d + 1) == p >> 1)
            assert under > limit
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), limit).count() == 0


def test_overfull_buckets_are_split_to_the_last_bit(spark):
    """Any two of these rows are over the limit together, so every one has a bucket of its own, however many bits that takes."""
    rng = random.Random(8)
    rows = [(i, "x" * rng.randrange(510, 600)) for i in range(3000)] + [(5000, "y" * 400)] * 7 + [(5001, "z" * 3000)] * 2
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 1000).collect()
    assert all(r.part == 0 and r.shard_rows == 1 for r in got if r.doc_id < 5000)
    assert len({(r.depth, r.prefix) for r in got if r.doc_id < 5000}) == 3000
    assert max(r.depth for r in got if r.doc_id < 5000) > 12 + sharding.SLACK_BITS
    same_key = [r for r in got if r.doc_id >= 5000]
    assert len(same_key) == 9 and all(r.depth == sharding.HASH_BITS for r in same_key) and max(r.shard_bytes for r in same_key if r.doc_id == 5000) <= 1000
    assert [r.shard_rows for r in same_key if r.doc_id == 5001] == [1, 1]


def test_sharding_sql_splits_as_deep(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    rows = [(i, "x" * rng.randrange(400_000, 600_000)) for i in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(queries.op6_sharding(spark, str(tmp_path)), con, queries.oracle_sql()["op6_sharding"])


def test_write_shards(spark, tmp_path, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sharding.write_shards(docs, f"{tmp_path}/s", 1 << 16).collect()
    back = spark.read.parquet(f"{tmp_path}/s")
    assert back.count() == docs.count() == sum(r.rows for r in got) and max(r.bytes for r in got) <= 1 << 16
    odd = spark.createDataFrame([(None, "a", "old"), (1, "b", "old"), (1, "b", "old"), (2, None, None)], "doc_id long, text string, shard string")
    assert sum(r.rows for r in sharding.write_shards(odd, f"{tmp_path}/odd").collect()) == 4
    back = spark.read.parquet(f"{tmp_path}/odd")
    assert sorted((r.doc_id or 0, r.text or "") for r in back.collect()) == [(0, "a"), (1, "b"), (1, "b"), (2, "")] and "old" not in {r.shard for r in back.collect()}


def test_chat(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob b", "yo"), (1, 2, "ann", None), (2, None, None, "x"), (None, 3, "cy", "z"), (None, 3, "cy", "z"), (None, 4, "system", "z"), (3, 0, "system", "alone")]
    df = spark.createDataFrame([(*t, "e") for t in turns], "conv_id long, turn long, role string, text string, mask string").repartition(3)
    rows = chat.rotate(df).collect()
    assert sorted((str(r.conv_id), str(r.participant)) for r in rows) == [("1", "ann"), ("1", "bob b"), ("2", "None"), ("None", "cy"), ("None", "cy")]
    r = next(r for r in rows if r.participant == "ann")
    assert r.text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>user name=bob%20b\nyo<|im_end|>\n"
    assert written(r) == ["hi < |im_end|><|im_end|>", "<|im_end|>"]
    assert all(r.n_turns == r.n_trained == 1 for r in rows if r.conv_id is None)
    assert chat.rotate(spark.createDataFrame([], df.schema)).count() == 0


def written(r):
    return [r.text[int(a) : int(b)] for a, b in (s.split("-") for s in r["mask"].split(";"))]


def test_chat_keeps_long_and_sparse_dialogues_whole(spark):
    rows = [(1, i * 1000, "abc"[i % 3] if i < 900 else "d", f"t{i}") for i in range(1000)] + [(2, 5, "a", str(i)) for i in range(300)]
    got = {(r.conv_id, r.participant): r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (1, "c"), (1, "d"), (2, "a")}
    for (conv, who), r in got.items():
        mine = [t for c, _, p, t in sorted(rows) if c == conv and p == who]
        assert r.n_turns == sum(c == conv for c, *_ in rows) and written(r) == [t + "<|im_end|>" for t in mine]


def test_chat_tells_all_speakers_apart(spark):
    names = ["李", "王", "_", "a b", "a_b", "a%20b", "a+b", "a*b", "a~b", "%", None, "Zoë", "Zoé", ""]
    df = spark.createDataFrame([(1, i, n, f"said {i}") for i, n in enumerate(names)], "conv_id long, turn long, role string, text string")
    rows = chat.rotate(df).collect()
    assert len(rows) == len(names) and all(written(r) == [f"said {names.index(r.participant)}<|im_end|>"] for r in rows)
    assert len({r.text for r in rows}) == len(names)


def test_chat_parity_on_odd_dialogues(spark, tmp_path):
    rng = random.Random(4)
    roles = ["system", "user", "assistant", "李", "a b~*+", None]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(0, 9000, 700)]), rng.choice(roles), rng.choice([None, "", "é <| x", f"t{i}"])) for i in range(400)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    same(queries.op8_chat(spark, str(tmp_path)), con, queries.oracle_sql()["op8_chat"])


def vectors():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        x = rng.normal(size=16)
        rows.append((i, x.tolist(), i % 3))
        if i % 10 == 0:
            for k in range(4):
                rows.append((1000 + 10 * i + k, (x + rng.normal(size=16) * 0.08 * k).tolist(), i % 3))
    dense = rng.normal(size=16)
    rows += [(5000 + i, (dense + rng.normal(size=16) * 0.05).tolist(), 1) for i in range(60)]
    rows += [(6000 + i, dense.tolist(), 1) for i in range(5)] + [(6100, (2 * dense).tolist(), 1), (6101, dense.tolist(), 2), (6102, dense.tolist(), None)]
    rows += [(7000, None, 1), (7001, [0.0] * 16, 1), (7002, [float("nan")] * 16, 1), (7003, [None] * 16, 1), (7004, [float("inf")] * 16, 1), (7005, [1.0, 2.0], 1), (7006, [], 1)]
    return [(v, e if e is None else [x if x is None else float(np.float32(x)) for x in e], lab) for v, e, lab in rows]


def linked(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()}


@pytest.mark.parametrize(("block", "few"), [(4096, 16), (16, 16), (4096, 0)])
def test_embeddings(spark, monkeypatch, block, few):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "FEW", few)
    df = spark.createDataFrame([(*r, 1) for r in vectors()], "vec_id long, embedding array<float>, label int, n_links int").repartition(4)
    got, want = linked(df), brute.embeddings(vectors())
    if few:
        assert got == want
    assert set(got) == set(want) and all(got[v][0] <= want[v][0] for v in want)
    assert sum(n for n, _ in got.values()) >= 0.95 * sum(n for n, _ in want.values())
    assert embeddings.near_duplicates(spark.createDataFrame([], df.schema)).count() == 0
    assert embeddings.near_duplicates(df.where("vec_id in (7001, 7002)")).count() == 2


def test_embeddings_of_all_lengths(spark):
    rng = np.random.default_rng(7)
    rows = [(1, [1.0, 0.0], "a"), (2, [2.0, 0.0], "a"), (3, [1.0], "a"), (4, [2.0], "a"), (5, [-3.0], "a"), (6, [1.0, 0.0, 0.0], "a"), (7, [2.0, 0.1, 0.0], "a"), (8, [1.0, 0.0, 0.0], "b"), (9, [1e-200, 0.0], "a"), (10, [1e200, 1e199], "a")]
    for i in range(90):
        d = int(rng.integers(1, 6))
        rows.append((100 + i, (np.ones(d) * 3 + rng.normal(size=d) * rng.choice([0.05, 1.0])).tolist(), "ab"[i % 2]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    assert linked(df) == brute.embeddings(rows)
    assert linked(df.where("vec_id in (3, 4, 5)")) == {3: (1, 3), 4: (1, 3), 5: (0, 5)}
    assert linked(df.where("vec_id in (6, 7, 8)")) == {6: (1, 6), 7: (1, 6), 8: (0, 8)}


def test_embeddings_measure_recall_on_their_own_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 16))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.12])
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    classes = df.select(F.col("vec_id").alias("rep"), "label", "embedding")
    monkeypatch.setattr(embeddings, "FEW", 0)
    index = embeddings.fitted(classes, 16, 200_000)
    assert index.visits < index.most
    probes = classes.where("rep % 50 = 0").select("rep", "label", F.lit(16).alias("d"), "embedding").toArrow()
    found = embeddings.reach(index, classes, 16, probes)
    want = sum(len(set(range(800)) & {j for j in range(800) if j != i and j % 2 == i % 2 and x[i] @ x[j] / np.linalg.norm(x[i]) / np.linalg.norm(x[j]) >= 0.98}) for i in range(0, 800, 50))
    assert found[-1][1] == want > 5
    assert max(m for v, m in found if v <= index.visits) >= 0.9 * want
    got = sum(n for n, _ in linked(df).values())
    assert got >= 0.9 * sum(n for n, _ in brute.embeddings(rows).values())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_parity(spark, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name])
