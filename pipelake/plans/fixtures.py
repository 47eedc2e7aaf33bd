"""Views that give the driver's tables the shape of the canonical ones. The SQL runs in Spark and in DuckDB alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "conversations")

VIEWS = {
    "f1_steps": """
SELECT l_orderkey AS workflow_id, CAST(rn AS INT) AS ordinal, concat('s', CAST(rn AS STRING)) AS step_id,
       CASE WHEN l_suppkey % 3 = 0 THEN 'bash' ELSE concat('tool', CAST(l_suppkey % 7 AS STRING)) END AS tool,
       CAST(l_linenumber % 4 + 1 AS INT) AS threads, l_returnflag AS rf, l_suppkey AS sk
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity,
        l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS rn FROM lineitem) x""",
    "f1_files": """
SELECT workflow_id, step_id, ordinal, 'out' AS kind, 0 AS pos, concat('a', CAST(ordinal AS STRING)) AS file FROM f1_steps
UNION ALL
SELECT workflow_id, step_id, ordinal, 'in', 0,
       CASE WHEN rf = 'N' THEN concat('a', CAST(CAST(floor(ordinal / 2.0) AS INT) AS STRING), chr(10), ',', chr(9), ' a', CAST(ordinal - 1 AS STRING))
            ELSE concat('a', CAST(CAST(floor(ordinal / 2.0) AS INT) AS STRING)) END
FROM f1_steps WHERE ordinal > 1""",
    "f1_edges": """
SELECT DISTINCT workflow_id, concat('s', CAST(p AS STRING)) AS src, step_id AS dst FROM (
  SELECT workflow_id, step_id, CAST(floor(ordinal / 2.0) AS INT) AS p FROM f1_steps WHERE ordinal > 1
  UNION ALL SELECT workflow_id, step_id, ordinal - 1 FROM f1_steps WHERE ordinal > 1 AND rf = 'N'
  UNION ALL SELECT workflow_id, step_id, 99 FROM f1_steps WHERE sk % 11 = 0 AND ordinal = 3
  UNION ALL SELECT workflow_id, 's1', 2 FROM f1_steps WHERE sk % 13 = 0 AND ordinal = 2) e""",
    "f2_events": """
SELECT 'run0' AS run_id, user_id AS step_id, event_id AS seq, CAST(ts AS TIMESTAMP) AS ts,
       CASE event_type WHEN 'view' THEN 'Started' WHEN 'purchase' THEN 'Completed' ELSE 'Failed' END AS event_type
FROM events WHERE event_type IN ('view', 'purchase', 'error')""",
    "f2_graph": """
SELECT a.conv_id AS graph_id, a.turn AS source, b.turn AS target
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""",
    "f3_state": """
SELECT user_id AS workflow_id, regexp_extract(props, '([0-9]+)', 1) AS step_id, event_id AS seq, CAST(ts AS TIMESTAMP) AS ts,
       CASE event_type WHEN 'purchase' THEN 'Completed' WHEN 'error' THEN 'Failed' ELSE 'Cleared' END AS event_type
FROM events WHERE event_type IN ('purchase', 'error', 'signup')""",
    "f3_paths": """
SELECT CAST(page_id % 40 AS INT) AS workflow_id, 'sample' AS name, page_id AS pos,
       regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS file FROM pages""",
    "f4_times": """
SELECT o_orderkey AS step_id, 'out' AS kind, CAST(o_orderdate AS TIMESTAMP) AS modified_at FROM orders
UNION ALL SELECT l_orderkey, 'in', CAST(l_shipdate AS TIMESTAMP) FROM lineitem""",
    "f5_templates": """
SELECT p_partkey AS step_id, concat(chr(9), replace(p_name, ' ', concat(' ,', chr(10), chr(160))), chr(13)) AS input,
       concat('out/', p_brand, ',,', chr(11), p_type, chr(12)) AS output,
       CASE p_partkey % 4 WHEN 0 THEN 'cat {input} > {output}' WHEN 1 THEN 'merge {inputs} -o {outputs}'
            WHEN 2 THEN 'run {sample} {input}' ELSE 'echo hello' END AS command FROM part""",
    "f6_ids": "SELECT l_orderkey AS workflow_id, l_linenumber AS step_id FROM lineitem",
    "f7_log": """
SELECT user_id AS run_id, event_id AS line_no,
       CASE event_type WHEN 'error' THEN 'Step failed: exit code 1' WHEN 'purchase' THEN 'Step completed'
            WHEN 'view' THEN '[PAUSED] Workflow paused' WHEN 'click' THEN '[RESUMED] Workflow resumed'
            ELSE 'Starting step' END AS line FROM events""",
    "f8_labels": "SELECT p_partkey AS node_id, concat(' ', p_name, ' / ', p_brand, ' ') AS label FROM part",
    "f10_samples": """
SELECT user_id AS run_id, CAST(ts AS TIMESTAMP) AS ts, event_id AS seq, value AS cpu, CAST(floor(value * 4194304) AS BIGINT) AS memory_bytes FROM events""",
}


def _needs(sql: str, names) -> list[str]:
    words = set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())
    return [n for n in names if n in words]


def view(spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """One adapted view as a DataFrame; what it reads is passed by name, so no catalog entry is left behind. ``known`` has views that are there already."""
    sql = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _needs(sql, TABLES)}
    frames |= {v: known[v] if known and v in known else view(spark, sf_dir, v, known) for v in _needs(sql, VIEWS)}
    sql = sql.replace("{", "{{").replace("}", "}}")
    for used in frames:
        sql = _named(sql, used)
    return spark.sql(sql, **frames)


def _named(sql: str, used: str) -> str:
    for before in ("FROM ", "JOIN "):
        for after in (" ", "\n", ")"):
            sql = sql.replace(before + used + after, before + "{" + used + "}" + after)
        if sql.endswith(before + used):
            sql = sql[: -len(used)] + "{" + used + "}"
    return sql


def with_views(sql: str) -> str:
    """The same views as common table expressions in front of a DuckDB query."""
    wanted: list[str] = []

    def add(text: str) -> None:
        for v in _needs(text, VIEWS):
            add(VIEWS[v])
            if v not in wanted:
                wanted.append(v)

    add(sql)
    body = sql.strip()
    heads = [f"{v} AS ({VIEWS[v]})" for v in wanted]
    recursive = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH "
    if body.startswith("WITH "):
        body = body.removeprefix("WITH RECURSIVE ").removeprefix("WITH ")
        return recursive + ",\n".join([*heads, body])
    return (recursive + ",\n".join(heads) + "\n" if heads else "") + body
