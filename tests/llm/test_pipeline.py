"""The pipeline's stages against brute force on the smallest documents, and the registry."""

from pathlib import Path

import numpy as np
import pytest

from tests.llm import brute


def test_stages(spark, sf_dir):
    import corpus_pipeline as C
    from iqlake.llm import decontamination, toxicity
    from iqlake.llm.common import stored

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in C.STAGES] == ["toxicity", "jaccard", "substrings", "decontamination", "packing"]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).where("predicted = 1").collect()}
    items = [brute.words(r.text, True) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for name, stage in C.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stored(stage(spark, docs, sf_dir), name)
        if name == "packing":
            break
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            assert set(after) == set(before) - bad
        elif name == "jaccard":
            assert set(after) == {d for d, (_, c) in brute.jaccard(before.items()).items() if d == c}
        elif name == "substrings":
            want = brute.substrings(before.items())
            for d, (n, gone, _) in want.items():
                assert (d not in after) == (n > 0 and n == gone)
                if d in after:
                    assert after[d] == before[d] if not gone else len(after[d].split(" ")) == n - gone
        else:
            for d in before:
                w = brute.words(before[d], True)
                has = any(brute.edits(i, w) == 0 for i in items if i) if len(w) < 3000 else False
                assert not (has and d in after)
                if d not in after:
                    assert any(brute.edits(i, w) <= decontamination.budget(len(i)) for i in items)
    assert {r.doc_id for r in docs.select("doc_id").collect()} == set(after)
    total = docs.agg({"length": "sum"}).first()[0]
    assert docs.agg({"sequence_id": "max"}).first()[0] == (total - 1) // 2048
    assert all(np.frombuffer(r.ids, np.uint16)[-1] == 1 for r in docs.where("not boundary").limit(50).collect())


def test_documents_without_doc_id_stay_in_the_jaccard_stage(spark, sf_dir):
    import corpus_pipeline as C

    rows = [(None, "a b c d e f"), (None, None), (3, "a b c d e f"), (7, "A b c d e f"), (9, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in C.one_of_each_group(spark, docs, sf_dir).collect()]
    assert sorted(got, key=str) == sorted((r for r in rows if r[0] != 7), key=str)


ODD = [(None, "a b c d e f", 1, "k"), (None, None, 2, "k"), (3, "a b c d e f", 3, None), (3, "a b c d e f", 3, None), (7, "A b c d e f", 4, "k"), (9, None, 5, "k"), (10, "", 6, "k"), (11, "word " * 60_000, 7, "k")]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_keep_odd_rows_and_all_columns(spark, sf_dir, empty):
    import corpus_pipeline as C

    rows = [] if empty else ODD
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int, kept string")
    want = {"toxicity": rows, "jaccard": [r for r in rows if r[0] != 7], "substrings": [(d, "word" if d == 11 else t, n, k) for d, t, n, k in rows], "decontamination": rows}
    for name, stage in C.STAGES:
        got = stage(spark, docs, sf_dir)
        if name in want:
            assert got.columns == docs.columns
            assert sorted(map(tuple, got.collect()), key=str) == sorted(want[name], key=str), name
        else:
            assert got.where("start = 0").count() == len(rows)


def test_leaks_go_without_doc_id_too(spark, sf_dir):
    import corpus_pipeline as C

    item = max((r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()), key=len)
    docs = spark.createDataFrame([(None, f"x {item} y"), (None, "x y"), (4, item)], "doc_id long, text string")
    assert [tuple(r) for r in C.drop_leaks(spark, docs, sf_dir).collect()] == [(None, "x y")]


def test_run_leaves_only_its_result(spark, sf_dir):
    import corpus_pipeline as C

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(shared.iterdir())
    assert C.run(spark, sf_dir).count() > 0
    assert [p.name.split("-")[:2] for p in set(shared.iterdir()) - before] == [["stage", "packing"]]


def test_registry():
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()
