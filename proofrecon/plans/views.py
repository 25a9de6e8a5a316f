"""Payment-shaped inputs derived from the driver tables with portable SQL (the same text for Spark and DuckDB).

A batch is a statement of three users' events, so that batches grow in number with the data and not in size; k numbers
its rows. Every credit has a claim; a fifth of the claims has a file hash, a fifth a near image hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "benchmark", "labels", "embeddings")

FIRST = "'Asha Ravi Meena Kiran Sunil Priya Arjun Divya Nikhil Latha Rohan Farah'"
LAST = "'Rao Sharma Iyer Khan Patel Menon Gupta Reddy Nair Das Bose Shetty'"

VIEWS = {
    "v_stmt": f"""
SELECT b.*, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY pos) - 1 AS BIGINT) AS k,
       CAST(50000 + sum(coalesce(credit, 0) - coalesce(debit, 0)) OVER (PARTITION BY batch_id ORDER BY pos) AS DECIMAL(18,2)) AS balance,
       concat('UPI/', coalesce(ref, 'NA'), '/', name, '/', upi) AS narration
FROM (SELECT CAST(floor(user_id / 3) AS BIGINT) AS batch_id, event_id AS pos, concat('S', lpad(CAST(event_id AS STRING), 9, '0')) AS row_id, ts AS dt,
             CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(50 * (1 + event_id % 8) AS DECIMAL(18,2)) END AS credit,
             CASE WHEN event_type NOT IN ('purchase', 'signup') THEN CAST(50 * (1 + event_id % 8) AS DECIMAL(18,2)) END AS debit,
             CASE WHEN event_id % 4 <> 0 THEN CAST(100000000000 + event_id * 7919 AS STRING) END AS ref,
             concat(split_part({FIRST}, ' ', CAST(event_id % 12 AS INT) + 1), ' ', split_part({LAST}, ' ', CAST((event_id * 5 + 3) % 12 AS INT) + 1)) AS name,
             concat('user', CAST(user_id AS STRING), '@bank') AS upi
      FROM events) b""",
    "v_claims": """
SELECT batch_id, concat('C', lpad(CAST(pos AS STRING), 9, '0')) AS claim_id, pos, k, CAST(pos % 10 AS INT) AS cls,
       CASE WHEN pos % 10 = 3 THEN CAST(credit * 10 AS DECIMAL(18,2)) ELSE credit END AS amount,
       CASE WHEN pos % 10 = 6 THEN dt + INTERVAL 400 DAY WHEN pos % 10 = 7 THEN dt - INTERVAL 400 DAY WHEN pos % 2 = 0 THEN dt + INTERVAL 5 MINUTE ELSE dt - INTERVAL 2 MINUTE END AS ts,
       CASE WHEN pos % 10 = 4 THEN CAST(999000000000 + pos AS STRING) WHEN pos % 10 IN (5, 6, 7) THEN NULL ELSE ref END AS reference,
       CASE WHEN pos % 7 = 0 THEN NULL ELSE name END AS payer_name, CASE WHEN pos % 5 = 0 THEN upi END AS payer_upi_id,
       CASE WHEN pos % 10 = 8 THEN 'failed' WHEN pos % 11 = 0 THEN 'pending' ELSE 'success' END AS status_shown,
       CASE WHEN pos % 97 = 0 THEN 'USD' ELSE 'INR' END AS currency,
       CASE WHEN pos % 5 = 0 THEN concat('sha256:', md5(CAST(CAST(floor(k / 60) AS BIGINT) AS STRING)), md5(concat('f', CAST(CAST(floor(k / 60) AS BIGINT) AS STRING))))
            WHEN pos % 5 = 1 THEN concat('dhash256:', lpad(CAST(pos % 16 AS STRING), 2, '0'), substr(md5(CAST(CAST(floor(k / 12) AS BIGINT) AS STRING)), 1, 30), md5(concat('p', CAST(CAST(floor(k / 12) AS BIGINT) AS STRING)))) END AS image_hash,
       0.95 - (pos % 5) / 10.0 AS conf_amount, 0.9 AS conf_ts, 0.6 + (pos % 4) / 10.0 AS conf_ref, 0.8 AS conf_name
FROM v_stmt WHERE credit IS NOT NULL""",
    "v_meta": """
SELECT batch_id, min(dt) AS coverage_start, max(dt) AS coverage_end, 0.45 + (batch_id % 10) / 20.0 AS parse_confidence FROM v_stmt GROUP BY batch_id""",
    "v_cells": """
SELECT l_orderkey * 10 + l_linenumber AS id, CAST((l_orderkey + l_linenumber) % 8 AS INT) AS style, cents, i, f,
       CASE CAST((l_orderkey + l_linenumber) % 8 AS INT)
         WHEN 0 THEN concat(CAST(i AS STRING), '.', f)
         WHEN 1 THEN concat(western, '.', f)
         WHEN 2 THEN concat(indian, '.', f, ' Cr')
         WHEN 3 THEN concat('(', CAST(i AS STRING), '.', f, ')')
         WHEN 4 THEN concat('₹ ', indian, '.', f)
         WHEN 5 THEN concat('Rs.', CAST(i AS STRING), '.', f, ' Dr')
         WHEN 6 THEN concat(replace(western, ',', '.'), ',', f)
         ELSE concat('-', CAST(i AS STRING), '.', f) END AS cell
FROM (SELECT *, CASE WHEN i >= 1000 THEN concat(CAST(CAST(floor(i / 1000) AS BIGINT) AS STRING), ',', lpad(CAST(i % 1000 AS STRING), 3, '0')) ELSE CAST(i AS STRING) END AS western,
             CASE WHEN i >= 100000 THEN concat(CAST(CAST(floor(i / 100000) AS BIGINT) AS STRING), ',', lpad(CAST(CAST(floor(i / 1000) AS BIGINT) % 100 AS STRING), 2, '0'), ',', lpad(CAST(i % 1000 AS STRING), 3, '0'))
                  WHEN i >= 1000 THEN concat(CAST(CAST(floor(i / 1000) AS BIGINT) AS STRING), ',', lpad(CAST(i % 1000 AS STRING), 3, '0')) ELSE CAST(i AS STRING) END AS indian
      FROM (SELECT l_orderkey, l_linenumber, cents, CAST(floor(cents / 100) AS BIGINT) AS i, lpad(CAST(cents % 100 AS STRING), 2, '0') AS f
            FROM (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem) a) b) c""",
    "v_dates": """
SELECT o_orderkey AS id, CAST(o_orderkey % 6 AS INT) AS style, y, m, d, h, mi,
       CASE CAST(o_orderkey % 6 AS INT)
         WHEN 0 THEN concat(dd, '/', mm, '/', yyyy, ' ', hh, ':', mins)
         WHEN 1 THEN concat(yyyy, '-', mm, '-', dd, 'T', hh, ':', mins, ':00Z')
         WHEN 2 THEN concat(dd, '-', mon, '-', yyyy)
         WHEN 3 THEN concat(mon, ' ', dd, ', ', yyyy)
         WHEN 4 THEN concat(yyyy, mm, dd)
         ELSE concat('Mon, ', dd, '.', mm, '.', substr(yyyy, 3, 2), ' ', CAST(CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END AS STRING), ':', mins, CASE WHEN h < 12 THEN ' AM' ELSE ' PM' END) END AS cell
FROM (SELECT *, lpad(CAST(d AS STRING), 2, '0') AS dd, lpad(CAST(m AS STRING), 2, '0') AS mm, CAST(y AS STRING) AS yyyy, lpad(CAST(h AS STRING), 2, '0') AS hh, lpad(CAST(mi AS STRING), 2, '0') AS mins,
             split_part('Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec', ' ', m) AS mon
      FROM (SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INT) AS y, CAST(extract(month FROM o_orderdate) AS INT) AS m, CAST(extract(day FROM o_orderdate) AS INT) AS d,
                   CAST(o_orderkey % 24 AS INT) AS h, CAST(o_orderkey % 60 AS INT) AS mi FROM orders) a) b""",
    "v_hash": """
SELECT doc_id AS id, concat(lpad(CAST(doc_id % 16 AS STRING), 2, '0'), substr(md5(concat('h', CAST(CAST(floor(doc_id / 48) AS BIGINT) AS STRING))), 1, 30), md5(CAST(CAST(floor(doc_id / 48) AS BIGINT) AS STRING))) AS h FROM documents WHERE doc_id IS NOT NULL""",
    "v_prints": """
SELECT doc_id AS id, concat(lpad(CAST(doc_id % 16 AS STRING), 2, '0'), substr(md5(CAST(CAST(floor(doc_id / 32) AS BIGINT) AS STRING)), 1, 30), md5(concat('p', CAST(CAST(floor(doc_id / 32) AS BIGINT) AS STRING)))) AS h FROM documents WHERE doc_id IS NOT NULL""",
    "v_msgs": """
SELECT event_id AS id, ts AS created_at, CAST(event_id % 17 AS INT) AS k, (event_id % 21) / 20.0 AS injection, (event_id % 13) / 12.0 AS phishing,
       CASE WHEN event_id % 11 = 0 THEN 'blocked' WHEN event_id % 7 = 0 THEN 'spf_fail' ELSE 'inbox' END AS label, event_id % 19 = 0 AS held, event_id % 23 = 0 AS hidden_text,
       CASE WHEN event_id % 29 = 0 THEN 'running' ELSE 'complete' END AS analysis,
       concat('File', CAST(event_id AS STRING), CASE CAST(event_id % 6 AS INT) WHEN 0 THEN '.CSV' WHEN 1 THEN '.pdf' WHEN 2 THEN '.PNG' WHEN 3 THEN '.jpeg' WHEN 4 THEN '.exe' ELSE '' END) AS filename, event_id % 5 = 0 AS inline
FROM events""",
}
VIEWS["v_all_claims"] = VIEWS["v_claims"]
#: Views that only parsers read, a row at a time.
CELLS = ("v_cells", "v_dates")
_NEEDS = {"v_claims": ("v_stmt",), "v_all_claims": ("v_stmt",), "v_meta": ("v_stmt",)}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input as a DataFrame, without registering anything in the session."""
    sql, frames = VIEWS[name], {}
    for need in (*_NEEDS.get(name, ()), *TABLES):
        marked = sql.replace(f"FROM {need} ", f"FROM {{{need}}} ").replace(f"FROM {need})", f"FROM {{{need}}})")
        marked = marked[: -len(need)] + f"{{{need}}}" if marked.endswith(f"FROM {need}") else marked
        if marked != sql:
            sql = marked
            frames[need] = view(spark, sf_dir, need) if need in VIEWS else spark.read.parquet(f"{sf_dir}/{need}.parquet")
            if name in CELLS and len(frames[need].inputFiles()) == 1:  # one file may be one task, which would parse all cells
                frames[need] = frames[need].repartition(spark.sparkContext.defaultParallelism)
    return spark.sql(sql, **frames)


def with_views(sql: str) -> str:
    """DuckDB SQL with the views that it names as common table expressions."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for x in _NEEDS.get(name, ()):
            need(x)
        if name not in wanted:
            wanted.append(name)

    for name in VIEWS:
        if name in sql:
            need(name)
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted) + (", " + sql[5:] if sql.lstrip().startswith("WITH ") else " " + sql) if wanted else sql
