"""Queries that write tables and files to the shared folder and scan them again, and digests of whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import identity as I
from ..functions import text as T
from ..operators import audit, digests, metrics, progress
from ..sources import archives, files, leases, scans, sinks
from . import views as V
from .registry import query
from .sample_queries import assigned


@query("SELECT l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL")
def csv_roundtrip(spark, sf_dir):
    """S30, K05."""
    rows = V.table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).cast("double").alias("quantity"))
    path = sinks.scratch(spark, "csv")
    sinks.publish(rows, path, "csv", header="true")
    return scans.csv_rows(spark, path, "l_linestatus string, n long, quantity double")


@query("""SELECT c.target::varchar AS target, p::varchar AS pred, count(pred) FILTER (pred = p) AS n FROM c, (SELECT unnest(range(10)) AS p)
  GROUP BY ALL""", "c")
def matrix_csv_roundtrip(spark, sf_dir):
    """S31, K06."""
    labels = [str(k) for k in range(V.CLASSES)]
    cells = metrics.confusion(V.replays(spark, sf_dir), [])
    wide = cells.groupBy(F.col("target").cast("string").alias("target")).pivot("pred", [int(x) for x in labels]).agg(F.sum("n"))
    path = sinks.scratch(spark, "matrix")
    sinks.publish(wide.na.fill(0), path, "csv", header="true")
    return scans.matrix_csv(spark, path, labels)


@query("SELECT model, seed, count(*) AS n, sum(pred)::bigint AS total FROM r WHERE seed IN (13, 101) GROUP BY ALL", "r")
def replay_roundtrip(spark, sf_dir):
    """Replays of two seeds, all models having both."""
    path = sinks.scratch(spark, "replays")
    sinks.publish_predictions(V.replays(spark, sf_dir), path)
    rows = scans.replays_of(spark, path, [13, 101])
    return rows.groupBy("model", "seed").agg(F.count(F.lit(1)).alias("n"), F.sum("pred").alias("total"))


@query("SELECT modulation, snr_db, count(*) AS n, round(sum(i[1]::double), 6) AS first FROM iq GROUP BY ALL", "iq")
def canonical_cells(spark, sf_dir):
    """A folder per cell, read back with the cell's keys from its path."""
    path = sinks.scratch(spark, "cells")
    sinks.publish_cells(V.iq_samples(spark, sf_dir), path, ["modulation", "snr_db"])
    return spark.read.parquet(path).groupBy("modulation", "snr_db").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("i")[0].cast("double")), 6).alias("first"))


@query("SELECT model, seed, round(avg(ok), 6) AS score, false AS test_accessed FROM c GROUP BY ALL", "c")
def metrics_scan(spark, sf_dir):
    """One JSON object per run, read with a schema that has to fit."""
    rows = V.checked(spark, sf_dir).groupBy("model", "seed").agg(F.round(F.avg("ok"), 6).alias("score")).withColumn("test_accessed", F.lit(False))
    path = sinks.scratch(spark, "runs")
    rows.withColumn("run", F.concat_ws("-", "model", F.col("seed").cast("string"))).repartition("run").write.partitionBy("run").json(path)
    return scans.json_objects(spark, path, "model string, seed int, score double, test_accessed boolean").select("model", "seed", "score", "test_accessed")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'broken' ELSE event_id::varchar END AS commit, event_id % 11 = 0 AS cut, event_id % 3 = 0 AS other, event_id % 5 = 0 AS late, event_id % 7 = 0 AS blank FROM events),
f AS (SELECT CASE WHEN cut THEN 'unknown' ELSE commit END AS commit, unnest(list_filter([CASE WHEN cut THEN 'unparseable' END, CASE
  WHEN NOT cut AND other THEN 'author_email' END, CASE WHEN NOT cut AND late THEN 'author_date' END, CASE WHEN NOT cut
  AND blank THEN 'name' END], lambda x: x IS NOT NULL)) AS issue FROM e)
SELECT commit, issue FROM f""")
def history_audit(spark, sf_dir):
    """An exported commit log, framed by control characters."""
    k = F.col("event_id")
    mail = lambda odd: F.when(odd, "me@example.org").otherwise("me@users.noreply.github.com")
    fields = [k.cast("string"), F.when(k % 7 == 0, " ").otherwise("me"), mail(k % 3 == 0), F.lit("me"), mail(F.lit(False)), F.when(k % 5 == 0, "2031-01-01T00:00:00+09:00").otherwise("2020-01-01T00:00:00Z")]
    record = F.when(k % 11 == 0, "broken\x1frecord").otherwise(F.concat_ws("\x1f", *fields))
    path = sinks.scratch(spark, "log")
    V.table(spark, sf_dir, "events").select(record.alias("value")).write.option("lineSep", "\x1e").text(path)
    return T.history_issues(scans.framed_log(spark, path), "2030-06-01")


@query("SELECT split, count(*) AS n FROM split WHERE split <> 'test' GROUP BY ALL", "split")
def pooled_scan(spark, sf_dir):
    """S33, X04."""
    return scans.pool(assigned(spark, sf_dir)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY md5('13:' || doc_id), doc_id) - 1 AS k FROM documents)
SELECT doc_id, k // 64 AS batch, (k % 64)::int AS position FROM d""")
def mini_batches(spark, sf_dir):
    """S34."""
    return scans.mini_batches(V.table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 64, 13)


@query("SELECT vec_id, i[1] AS first, len(q)::int AS n FROM iq", "iq")
def preprocess_raw(spark, sf_dir):
    """P09."""
    return V.iq_samples(spark, sf_dir).select("vec_id", A.raw(F.col("i"))[0].alias("first"), F.size(A.raw(F.col("q"))).alias("n"))


@query("""SELECT item_id, sha256('{"id":' || item_id || ',"text":' || to_json(text) || '}') AS digest FROM benchmark""")
def json_row_digest(spark, sf_dir):
    """H03."""
    return V.table(spark, sf_dir, "benchmark").select("item_id", I.row_digest(F.struct(F.col("item_id").alias("id"), "text")).alias("digest"))


CELLS = "cl AS (SELECT modulation, snr_db, sha256(unhex(string_agg(hx, '' ORDER BY source_index))) AS h FROM iq JOIN fx USING (vec_id) GROUP BY ALL)"


def _cells(spark, sf_dir):
    """(modulation, snr_db, n, sha256) over the float bytes of each cell's windows."""
    rows = V.iq_samples(spark, sf_dir).select("modulation", "snr_db", "source_index", F.concat("i", "q").alias("raw"))
    return digests.group_digests(rows, ["modulation", "snr_db"], ["source_index"], "raw").withColumnRenamed("digest", "sha256")


@query(f"""WITH {CELLS} SELECT modulation, snr_db, count(*) AS n, any_value(h) AS sha256 FROM iq JOIN cl USING (modulation, snr_db) GROUP BY ALL""", "iq", "fx")
def cell_digests(spark, sf_dir):
    """The content of every cell, by its samples' bytes in order."""
    return _cells(spark, sf_dir)


@query(f"""WITH {CELLS}, e AS (SELECT list(encode(modulation::varchar) || '\\x00'::blob || encode(snr_db::varchar) || '\\x00'::blob || unhex(h) ORDER BY modulation::varchar, snr_db) AS l FROM cl)
SELECT sha256(list_reduce(l, lambda a, b: a || b)) AS digest FROM e""", "iq", "fx")
def source_digest(spark, sf_dir):
    """H05 over the digests of the cells' bytes."""
    return I.source_digest(_cells(spark, sf_dir).withColumn("modulation", F.col("modulation").cast("string")))


_LEN = "unhex(lpad(hex({}), 16, '0'))"


@query(f"""WITH {CELLS}, e AS (SELECT modulation, list({_LEN.format("strlen('snr' || snr_db)")} || encode('snr' || snr_db) || {_LEN.format("3")} || encode('<f4') || {_LEN.format("3")} || {_LEN.format("n")} || {_LEN.format("2")} || {_LEN.format("32")} || unhex(h) ORDER BY snr_db) AS l
  FROM cl JOIN (SELECT modulation, snr_db, count(*) AS n FROM iq GROUP BY ALL) USING (modulation, snr_db) GROUP BY modulation)
SELECT modulation, sha256(list_reduce(l, lambda a, b: a || b)) AS digest FROM e""", "iq", "fx")
def content_digest(spark, sf_dir):
    """H04 over one record per level: the cell's windows as an array of n x 2 x 32 floats."""
    shape = F.array(F.col("n"), F.lit(2).cast("long"), F.lit(32).cast("long"))
    rows = _cells(spark, sf_dir).select("modulation", F.col("snr_db").alias("ord"), F.concat(F.lit("snr"), F.col("snr_db").cast("string")).alias("name"), F.lit("<f4").alias("dtype"), shape.alias("shape"), "sha256")
    return I.content_digest(rows, ["modulation"])


_KEY = " || ".join(f"substr(lpad(hex(vec_id), 16, '0'), {k}, 2)" for k in range(15, 0, -2))


@query(f"""WITH p AS (SELECT ord, {_LEN.format("strlen(s)")} || encode(s) || {_LEN.format("count(vec_id)")} || unhex(coalesce(string_agg({_KEY}, '' ORDER BY vec_id), '')) AS b, count(vec_id) AS n
  FROM (VALUES (0, 'train'), (1, 'validation'), (2, 'test')) v(ord, s) LEFT JOIN split ON split = s GROUP BY ord, s)
SELECT sum(n)::bigint AS n, sha256(list_reduce(list(b ORDER BY ord), lambda x, y: x || y)) AS digest FROM p""", "split")
def assignment_digest(spark, sf_dir):
    """One digest over the sorted keys of all splits."""
    return digests.assignment_digest(assigned(spark, sf_dir), "vec_id")


QUEUE = """q AS (SELECT model, seed, round(avg(ok), 6) AS score FROM c GROUP BY ALL), t AS (SELECT *, unnest(CASE WHEN model = 'm1' AND seed = 37 THEN [1, 2] ELSE [1] END) AS copy FROM q WHERE NOT (model = 'm2' AND seed = 73)),
e AS (SELECT model, seed FROM models, seeds WHERE seed <> 137)"""


@query(f"""WITH {QUEUE}, a AS (SELECT model, seed, list_filter([CASE WHEN model = 'm3' AND seed = 13 THEN 'bindings' END, CASE WHEN seed = 101 AND model = 'm1' THEN 'test_access' END, CASE WHEN model = 'm2' AND seed = 13 THEN 'checkpoint' END,
  CASE WHEN model = 'm3' AND seed = 37 THEN 'last_state' END, CASE WHEN model = 'm2' AND seed = 37 THEN 'score' END, CASE WHEN model = 'm3'
  AND seed = 101 THEN 'epochs' END, CASE WHEN model = 'm3' AND seed IN (73, 101) THEN 'history' END,
  CASE WHEN model = 'm1' AND seed = 37 THEN 'repeated' END, CASE WHEN seed = 137 THEN 'unexpected' END], lambda x: x IS NOT NULL) AS i FROM t)
SELECT model, seed, array_to_string(i, ',') AS issues FROM a UNION ALL SELECT model, seed, 'missing' FROM (SELECT model, seed
  FROM e EXCEPT SELECT model, seed FROM t)""", "c")
def queue_audit(spark, sf_dir):
    """A queue of runs with one fault of each kind."""
    at = lambda m, *s: (F.col("model") == m) & F.col("seed").isin(*s)
    runs = V.checked(spark, sf_dir).groupBy("model", "seed").agg(F.round(F.avg("ok"), 6).alias("score")).where(~at("m2", 73))
    runs = runs.withColumn("copy", F.explode(F.when(at("m1", 37), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    bindings = lambda commit: F.struct(F.col("seed").alias("seed"), commit.alias("commit"), F.lit(None).cast("string").alias("note"))
    epochs, length = F.when(at("m3", 101), 99).otherwise(100), F.when(at("m3", 73, 101), 99).otherwise(100)
    runs = runs.select(
        "model", "seed", "score", bindings(F.lit("a")).alias("expected_bindings"), bindings(F.when(at("m3", 13), "b").otherwise("a")).alias("bindings"),
        at("m1", 101).alias("test_accessed"), F.lit(False).alias("summary_test_accessed"), F.lit("x").alias("checkpoint_sha256"), F.when(at("m2", 13), "y").otherwise("x").alias("stored_sha256"), F.lit("x").alias("summary_sha256"),
        at("m3", 37).alias("keeps_last"), (F.col("score") + F.when(at("m2", 37), 0.1).otherwise(0.0)).alias("recorded_score"), epochs.alias("epochs"), F.sequence(F.lit(1), length).alias("history"),
    )
    expected = V.model_dim(spark).select("model").crossJoin(V.seed_dim(spark)).where("seed <> 137")  # models x seeds, a fixed few rows
    return audit.queue_audit(runs, expected, ["model", "seed"], audit.run_rules(100)).select("model", "seed", F.array_join("issues", ",").alias("issues"))


@query("SELECT model || '-' || seed_idx AS run, max(epoch)::int AS epoch FROM runs GROUP BY ALL", "runs")
def progress_events(spark, sf_dir):
    """Events written by the runs, parsed again."""
    from ..streaming.progress import progress_events as events

    return progress.parse_log(events(V.runs(spark, sf_dir))).groupBy("run").agg(F.max("epoch").alias("epoch"))


@query("""SELECT lang || '/' || doc_id || '.txt' AS member, strlen(text)::bigint AS size, 'file' AS kind, sha256(text) AS sha256, true AS safe
  FROM documents WHERE lang = 'en' OR lang = 'de'""")
def archive_scan(spark, sf_dir):
    """All documents as members of archives; the filters on members reach the scan."""
    path = sinks.scratch(spark, "archives")
    docs = V.table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("member"), F.encode("text", "utf-8").alias("content"))
    archives.write_archives(docs, path)
    read = lambda lang: archives.tar_members(spark, path, pathGlobFilter="*.bz2").where(F.col("member").startswith(f"{lang}/"))
    return read("en").unionByName(read("de")).drop("path")



@query("SELECT sum(strlen(text))::bigint AS bytes, count(*) AS members, true AS safe, true AS within FROM documents")
def archive_inventory(spark, sf_dir):
    """Members, bytes and safety of every archive, added up."""
    path = sinks.scratch(spark, "archives")
    docs = V.table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("member"), F.encode("text", "utf-8").alias("content"))
    archives.write_archives(docs, path)
    each = archives.archive_inventory(archives.tar_members(spark, path, pathGlobFilter="*.bz2", digests=False))
    return each.agg(F.sum("bytes").alias("bytes"), F.sum("members").alias("members"), F.bool_and("safe").alias("safe"), F.bool_and(F.col("members") <= 64).alias("within"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY ALL")
def leased_publish(spark, sf_dir):
    """A table of two versions under leases; readers see the latest that has a manifest."""
    path, docs = sinks.scratch(spark, "leased"), V.table(spark, sf_dir, "documents").select("doc_id", "lang")
    first = leases.acquire(spark, path)
    first.publish(docs.where("lang = 'en'"))
    first.release()
    leases.acquire(spark, path).publish(docs)
    return leases.published(spark, path).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT lang AS name, CASE WHEN lang = 'en' THEN 2 ELSE 1 END AS files, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS read, sum(strlen(doc_id::varchar) + 1)::bigint AS bytes
  FROM documents GROUP BY lang""")
def file_state(spark, sf_dir):
    """The ids of each language as files, of which one is new; only that one is read for its digest."""
    path, ids = sinks.scratch(spark, "files"), V.table(spark, sf_dir, "documents").select("lang", F.col("doc_id").cast("string").alias("value"))
    late = (F.col("lang") == "en") & (F.length("value") == 1)
    ids.where(~late).repartition("lang").write.partitionBy("lang").text(path)
    known = files.cached_digests(spark, path, glob="*.txt")
    kept = sinks.scratch(spark, "known")
    known.write.parquet(kept)
    ids.where(late).coalesce(1).write.mode("append").partitionBy("lang").text(path)
    known = spark.read.parquet(kept)
    fresh = files.unread(files.cached_digests(spark, path, known, "*.txt"), known).select("path", F.lit(1).alias("_new"))
    now = files.cached_digests(spark, path, known, "*.txt").where("sha256 is not null").join(fresh, "path", "left")
    return now.groupBy(F.regexp_extract("path", "lang=([^/]+)", 1).alias("name")).agg(F.count(F.lit(1)).alias("files"), F.count("_new").alias("read"), F.sum("size").alias("bytes"))
