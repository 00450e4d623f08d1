"""Timed-text tables derived from the relational test tables.

Each view is one SELECT in the dialect that Spark SQL and DuckDB share, so
that either engine can build it. ``{name}`` stands for a base table or view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "points": """SELECT CAST(user_id % 40 AS VARCHAR(20)) AS video_id, event_id AS seq, CAST(event_id % 900 AS DOUBLE) / 4 AS "start", CAST(event_id % 900 AS DOUBLE) / 4 AS "end",
        CASE WHEN event_id % 3 = 0 THEN upper(event_type) WHEN event_id % 7 = 0 THEN concat(' ', event_type) WHEN event_id % 11 = 0 THEN concat('@', event_type) WHEN event_id % 13 = 0 THEN '  ' ELSE event_type END AS text,
        CASE WHEN event_id % 6 = 0 THEN 'SPEECH' WHEN event_id % 6 = 5 THEN 'BOTH' ELSE 'ON-SCREEN' END AS source,
        CAST(NULL AS DOUBLE) AS asr_logprob, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id % 10 AS DOUBLE) / 10 END AS ocr_confidence, 'en' AS language FROM {events}""",
    "turns": """SELECT CAST(conv_id AS VARCHAR(20)) AS video_id, turn AS seq, CAST(turn * 10 AS DOUBLE) AS "start", CAST(turn * 10 + 12 AS DOUBLE) AS "end", text,
        CASE WHEN role = 'user' THEN 'SPEECH' ELSE 'ON-SCREEN' END AS source, CAST(NULL AS DOUBLE) AS asr_logprob, CAST(NULL AS DOUBLE) AS ocr_confidence, 'en' AS language FROM {conversations}""",
    "captions": """SELECT video_id, seq + 1000 AS seq, "start" + 1 AS "start", "end" - 1 AS "end", CASE WHEN seq % 6 = 0 THEN concat(text, '!') WHEN seq % 6 = 2 THEN upper(text) ELSE repeat('#', 40) END AS text,
        'ON-SCREEN' AS source, asr_logprob, CAST(0.9 AS DOUBLE) AS ocr_confidence, 'de' AS language FROM {turns} WHERE source = 'SPEECH'""",
    "speech": "SELECT * FROM {turns} WHERE source = 'SPEECH'",
    "rects": """SELECT CAST(l_suppkey % 20 AS VARCHAR(20)) AS video_id, CAST(l_orderkey AS DOUBLE) AS frame_ts, CAST(row_number() OVER (PARTITION BY l_suppkey % 20, l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag) AS INT) AS pos,
        CAST(l_partkey % 640 AS DOUBLE) AS x0, CAST(l_quantity * 4 AS DOUBLE) AS y0, CAST(l_partkey % 640 + 40 + l_linenumber * 9 AS DOUBLE) AS x1, CAST(l_quantity * 4 + 20 + l_partkey % 5 AS DOUBLE) AS y1,
        concat(l_returnflag, l_linestatus) AS text, 1 - l_discount * 5 AS score FROM {lineitem}""",
    "expected": """SELECT video_id, seq AS gt_seq, concat(text, CASE WHEN seq % 8 = 0 THEN '.' ELSE '' END) AS text, CASE WHEN seq % 8 = 4 THEN NULL ELSE "start" END AS "start", CASE WHEN seq % 8 = 4 THEN NULL ELSE "end" END AS "end", seq % 8 <> 6 AS required FROM {speech}""",
    "marks": """SELECT CAST(user_id % 25 AS VARCHAR(20)) AS video_id, event_id AS seq, CAST(event_id % 97 AS DOUBLE) AS "start", CAST(event_id % 97 + 1 + event_id % 3 AS DOUBLE) AS "end",
        CASE WHEN event_id % 5 = 0 THEN upper(event_type) WHEN event_id % 11 = 0 THEN concat(event_type, '!') WHEN event_id % 13 = 0 THEN concat('a ', event_type) WHEN event_id % 17 = 0 THEN concat(event_type, 's and more than that') ELSE event_type END AS text,
        CASE WHEN event_id % 4 = 1 THEN 'SPEECH' ELSE 'ON-SCREEN' END AS source, CAST(NULL AS DOUBLE) AS asr_logprob, CAST(NULL AS DOUBLE) AS ocr_confidence, 'en' AS language FROM {events} WHERE event_id % 4 < 2""",
    "sought": """SELECT CAST(user_id % 25 AS VARCHAR(20)) AS video_id, event_id AS gt_seq, CASE event_id % 5 WHEN 0 THEN event_type WHEN 1 THEN concat(event_type, ' view') WHEN 2 THEN concat('click ', event_type, ' error') WHEN 3 THEN concat(event_type, 'x error, view') ELSE 'Nothing of this' END AS text,
        CASE WHEN event_id % 71 = 0 THEN NULL ELSE CAST(event_id % 97 - 2 AS DOUBLE) END AS "start", CASE WHEN event_id % 89 = 0 THEN NULL ELSE CAST(event_id % 97 + 2 AS DOUBLE) END AS "end", event_id % 7 <> 0 AS required FROM {events} WHERE event_id % 43 = 0""",
    "records": """SELECT concat('clip', CAST(o_custkey % 7 AS VARCHAR(20))) AS clip, CASE WHEN o_orderkey % 5 = 0 THEN 'de' WHEN o_orderkey % 5 = 1 THEN 'en' WHEN o_orderkey % 5 = 2 THEN 'fr' ELSE 'es' END AS language,
        CASE WHEN o_custkey % 2 = 0 THEN 'base' ELSE 'new' END AS ocr_model_set, o_orderkey % 9 AS expected, (o_orderkey % 9) * (o_custkey % 4) // 4 AS matched, o_orderkey % 50 + 1 AS segments, (o_orderkey % 50 + 1) * (o_custkey % 3) // 4 AS unmatched, CAST(o_custkey % 10 AS DOUBLE) / 10 AS raw_recall FROM {orders}""",
    "geometry": """SELECT CAST(l_suppkey % 20 AS VARCHAR(20)) AS video_id, l_orderkey * 10 + l_linenumber AS seq, concat(l_returnflag, l_linestatus, CAST(l_partkey % 9 AS VARCHAR(20))) AS text, lower(concat(l_returnflag, l_linestatus, CAST(l_partkey % 9 AS VARCHAR(20)))) AS "key",
        l_quantity / 64 AS normalized_height, CAST(l_partkey % 640 AS DOUBLE) / 640 AS x_center_norm, CAST(l_orderkey % 480 AS DOUBLE) / 480 AS y_center_norm, l_linenumber = 1 AS matched FROM {lineitem}""",
}


def _needs(sql: str) -> list[str]:
    return [n for n in [*BASE, *VIEWS] if "{" + n + "}" in sql]


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table or a derived view of a data folder."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace("//", "div").replace('"', "`")
    return spark.sql(sql, **{n: load(spark, sf_dir, n) for n in _needs(VIEWS[name])})


def with_views(sql: str) -> str:
    """A DuckDB query over views, with their definitions in front."""
    order: list[str] = []

    def visit(text: str) -> None:
        for n in _needs(text):
            if n in VIEWS and n not in order:
                visit(VIEWS[n])
                order.append(n)

    visit(sql)
    fill = lambda text: text.format(**{n: n for n in _needs(text)})
    heads = [f"{n} AS ({fill(VIEWS[n])})" for n in order]
    body = sql
    for n in _needs(sql):
        body = body.replace("{" + n + "}", n)
    if not heads:
        return body
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ",\n".join(heads) + ",\n" + body.lstrip()[len("WITH RECURSIVE") :]
    if body.lstrip().upper().startswith("WITH"):
        return "WITH " + ",\n".join(heads) + ",\n" + body.lstrip()[len("WITH") :]
    return "WITH " + ",\n".join(heads) + "\n" + body
