"""Register of queries, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: DuckDB forms of the views in ``views``, each with those it builds on.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "iq": ((), """SELECT vec_id, label AS modulation, ((vec_id % 10) * 2 - 10)::int AS snr_db,
        row_number() OVER (PARTITION BY label, vec_id % 10 ORDER BY vec_id) - 1 AS source_index,
        embedding[1:32] AS i, embedding[33:64] AS q FROM embeddings"""),
    "ids": (("iq",), "SELECT *, printf('emb:%02d:%+03d:%04d', modulation, snr_db, source_index) AS sample_id FROM iq"),
    # a window's float32 bytes in hex, little-endian: sign, exponent and fraction by arithmetic
    "fx": (("iq",), """SELECT vec_id, string_agg(substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2), '' ORDER BY p) AS hx FROM (
        SELECT vec_id, p, printf('%08x', CASE WHEN a = 0 THEN 0::bigint ELSE (x < 0)::bigint * 2147483648 + (e + 127)::bigint * 8388608 + ((a / pow(2.0, e) - 1) * 8388608)::bigint END) AS h FROM (
        SELECT *, CASE WHEN a >= pow(2.0, e0 + 1) THEN e0 + 1 WHEN a < pow(2.0, e0) THEN e0 - 1 ELSE e0 END AS e FROM (
        SELECT *, floor(log2(CASE WHEN a = 0 THEN 1 ELSE a END))::int AS e0 FROM (
        SELECT *, abs(x::double) AS a FROM (SELECT vec_id, unnest(range(64)) AS p, unnest(list_concat(i, q)) AS x FROM iq))))) GROUP BY vec_id"""),
    "models": ((), "SELECT * FROM (VALUES ('m1', 'a'), ('m2', '8'), ('m3', 'c')) v(model, thr)"),
    "seeds": ((), "SELECT * FROM (VALUES (13), (37), (73), (101), (137)) v(seed)"),
    "rep0": (("models", "seeds"), """SELECT model, seed, vec_id, label AS target, ((vec_id % 10) * 2 - 10)::int AS snr_db, thr,
        md5(model || ':' || seed || ':' || vec_id) AS h FROM embeddings, models, seeds"""),
    "r": (("rep0",), """SELECT model, seed, vec_id, target, snr_db,
        CASE WHEN substr(h, 1, 1) < thr THEN target ELSE (ascii(substr(h, 2, 1)) + target) % 10 END AS pred FROM rep0"""),
    "c": (("r",), "SELECT *, (pred = target)::int AS ok FROM r"),
    "gates": ((), """SELECT vec_id, block, [w[1] / (w[1] + w[2] + w[3]), w[2] / (w[1] + w[2] + w[3]), w[3] / (w[1] + w[2] + w[3])] AS w
        FROM (SELECT vec_id, block, [abs(embedding[3*block+1]::double) + 0.001, abs(embedding[3*block+2]::double) + 0.001,
  abs(embedding[3*block+3]::double) + 0.001] AS w
              FROM embeddings, (SELECT unnest(range(6))::int AS block))"""),
    "logits": ((), "SELECT vec_id, label AS target, ((vec_id % 10) * 2 - 10)::int AS snr_db, list_transform(embedding[1:10], lambda x: x::double) AS l FROM embeddings"),
    "probs": (("logits",), """SELECT vec_id, target, snr_db, l, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (
        SELECT *, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM logits)"""),
    "runs": ((), """SELECT event_id, ts, event_type AS model, (user_id % 5)::int AS seed_idx, (props->>'k')::int AS epoch, value AS score
  FROM events"""),
    "ranked": (("ids",), """SELECT vec_id, sample_id, modulation, snr_db, source_index,
        sha256(unhex(lpad(hex(21), 16, '0')) || encode('demo/split-ranking/v1') || unhex(lpad(hex(4), 16, '0')) || encode('2026')
          || unhex(lpad(hex(strlen(sample_id)), 16, '0')) || encode(sample_id)) AS digest FROM ids"""),
    "alloc": (("iq",), """SELECT modulation, snr_db, ord, split, base + (CASE WHEN rk <= n - sum_base THEN 1 ELSE 0 END) AS cnt FROM (
        SELECT *, sum(base) OVER (PARTITION BY modulation, snr_db) AS sum_base,
          row_number() OVER (PARTITION BY modulation, snr_db ORDER BY rem DESC, ord) AS rk FROM (
          SELECT modulation, snr_db, n, ord, split, n * w // 10 AS base, n * w % 10 AS rem FROM
            (SELECT modulation, snr_db, count(*) AS n FROM iq GROUP BY ALL),
            (VALUES (0, 'train', 7), (1, 'validation', 1), (2, 'test', 2)) v(ord, split, w)))"""),
    "split": (("ranked", "alloc"), """SELECT k.vec_id, k.sample_id, k.modulation, k.snr_db, a.split FROM
        (SELECT *, row_number() OVER (PARTITION BY modulation, snr_db ORDER BY digest, sample_id) AS rk FROM ranked) k
        JOIN (SELECT *, sum(cnt) OVER (PARTITION BY modulation, snr_db ORDER BY ord) AS hi,
              sum(cnt) OVER (PARTITION BY modulation, snr_db ORDER BY ord) - cnt AS lo FROM alloc) a
        ON k.modulation = a.modulation AND k.snr_db = a.snr_db AND k.rk > a.lo AND k.rk <= a.hi"""),
}


def with_views(sql: str, *names: str) -> str:
    """``sql`` after the CTEs of the named views and of what they build on."""
    done: list[str] = []

    def add(name: str) -> None:
        for below in CTES[name][0]:
            add(below)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    ctes = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in done)
    own = sql.strip()
    if not ctes:
        return own
    return f"WITH {ctes},\n{own[5:]}" if own[:5].upper() == "WITH " else f"WITH {ctes}\n{own}"


def query(sql: str | None = None, *views: str, name: str = ""):
    """Register a query under its function's name; ``sql`` may use the named CTEs."""

    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE[name or f.__name__] = with_views(sql, *views)
        return f

    return put
