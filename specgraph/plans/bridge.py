"""Inputs of the library's shapes, derived from the given tables by SQL that both Spark and the checking engine run.

Each view is one SELECT over base tables or earlier views. ``frame`` gives one as a DataFrame; ``with_views`` puts the same text in
front of a checking query.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from specgraph.operators.walk import shared_checkpoint

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark", "pages", "conversations")

VIEWS: dict[str, str] = {
    # inventory
    "b_collection": "SELECT CAST(r_regionkey AS STRING) AS id, r_name AS name FROM region",
    "b_site": "SELECT CAST(n_nationkey AS STRING) AS id, n_name AS name, CASE WHEN n_nationkey % 6 = 5 THEN 'none' ELSE CAST(n_regionkey AS STRING) END AS collection_id FROM nation",
    "b_group": "SELECT DISTINCT c_mktsegment AS id, 'group ' || c_mktsegment AS name FROM customer",
    "b_device": """SELECT 'C' || CAST(c_custkey AS STRING) AS serial, c_name AS name, CASE WHEN c_custkey % 11 = 0 THEN 'lost' ELSE CAST(c_nationkey AS STRING) END AS site_id,
        c_mktsegment AS group_id, CASE WHEN c_acctbal < 0 THEN 'OFFLINE' ELSE 'ONLINE' END AS status,
        CASE c_custkey % 3 WHEN 0 THEN 'SWITCH' WHEN 1 THEN 'AP' ELSE 'GATEWAY' END AS device_type, 'v' || CAST(c_custkey % 7 AS STRING) AS firmware FROM customer""",
    "b_link": """SELECT 'C' || CAST(o_custkey AS STRING) AS from_id, CASE WHEN l_suppkey % 3 = 0 THEN 'C' || CAST(l_suppkey * 5 AS STRING) ELSE 'tpd_' || CAST(l_suppkey AS STRING) END AS to_id,
        CAST((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS BIGINT) AS ord, 'p' || CAST(l_linenumber AS STRING) AS from_port, 'q' || CAST(l_partkey % 8 AS STRING) AS to_port,
        l_quantity * 1e9 AS speed_bps, CASE WHEN l_linestatus = 'O' THEN 'lag' || CAST(l_linenumber AS STRING) ELSE '' END AS lag,
        CASE l_returnflag WHEN 'A' THEN 'Good' WHEN 'R' THEN 'Poor' ELSE '' END AS health,
        CASE WHEN l_discount > 0.05 THEN 'FORWARDING' WHEN l_discount > 0.02 THEN 'BLOCKING' ELSE '' END AS stp_state
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "b_site_edge": """SELECT site_id, u, v FROM (SELECT CAST(c_nationkey AS STRING) AS site_id, CAST(c_custkey AS BIGINT) AS v,
        CAST(lag(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 13, c_custkey) AS BIGINT) AS u, c_custkey % 7 AS k FROM customer) x WHERE u IS NOT NULL AND k <> 3""",
    "b_site_node": "SELECT CAST(c_nationkey AS STRING) AS site_id, CAST(c_custkey AS BIGINT) AS node FROM customer",
    "b_sync": "SELECT event_type AS label, user_id, max(ts) AS synced_at FROM events WHERE event_id % 17 <> 0 GROUP BY event_type, user_id UNION ALL SELECT 'never', user_id, CAST(NULL AS TIMESTAMP) FROM (SELECT DISTINCT user_id FROM events) u",
    # catalogue
    "b_endpoint": """SELECT CASE p_size % 5 WHEN 0 THEN 'POST' WHEN 1 THEN 'PUT' WHEN 2 THEN 'PATCH' ELSE 'GET' END || ':/v1/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '-')) || '/' || CAST(p_partkey AS STRING) AS eid,
        CASE p_size % 5 WHEN 0 THEN 'POST' WHEN 1 THEN 'PUT' WHEN 2 THEN 'PATCH' ELSE 'GET' END AS method,
        '/v1/' || lower(p_type) || '/' || lower(replace(p_brand, '#', '-')) || '/' || CAST(p_partkey AS STRING) AS path, p_brand AS category, p_name AS summary,
        'op' || CAST(p_partkey AS STRING) AS operation_id, lower(p_type) AS tag, p_size % 7 = 0 AS deprecated, CAST(p_partkey AS BIGINT) AS ord FROM part""",
    "b_component": """SELECT 'prov' || CAST(p_partkey % 3 AS STRING) || ':schemas:P' || CAST(p_partkey AS STRING) AS id, 'P' || CAST(p_partkey AS STRING) AS name, CAST(p_partkey AS BIGINT) AS ord,
        CASE WHEN p_partkey % 19 = 0 THEN 'unresolved' WHEN p_size % 4 = 0 THEN 'union' WHEN p_size % 4 = 1 THEN 'map' ELSE 'object' END AS kind,
        '{"type":"object","title":"' || p_name || '","size":' || CAST(p_size AS STRING) || '}' AS body_json FROM part""",
    "b_property": """SELECT c.id || '#prop:s' || CAST(l_suppkey AS STRING) AS id, c.id AS component_id, 's' || CAST(l_suppkey AS STRING) AS name,
        CASE WHEN max(l_quantity) > 45 THEN true ELSE false END AS required, CASE WHEN min(l_returnflag) = 'R' THEN true ELSE false END AS read_only,
        CASE CAST(l_suppkey AS BIGINT) % 4 WHEN 0 THEN NULL WHEN 1 THEN 'SWITCH' WHEN 2 THEN 'AP' ELSE '' END AS device_types,
        CASE WHEN l_suppkey % 5 = 0 THEN '/mod' || CAST(l_suppkey % 4 AS STRING) || ':top/leaf' || CAST(l_suppkey AS STRING) ELSE '' END AS yang_path,
        CASE l_suppkey % 3 WHEN 0 THEN 'string' WHEN 1 THEN 'integer' ELSE 'object' END AS type, 'prov' || CAST(l_suppkey % 3 AS STRING) || ':schemas:P' || CAST(l_suppkey AS STRING) AS type_id
        FROM lineitem JOIN b_component c ON c.ord = l_partkey GROUP BY c.id, l_suppkey""",
    "b_composed": "SELECT a.id AS a, b.id AS b FROM b_component a JOIN b_component b ON b.ord = CAST(floor(a.ord / 2) AS BIGINT)",
    "b_value": "SELECT a.id AS a, b.id AS b FROM b_component a JOIN b_component b ON b.ord = CAST(floor(a.ord / 3) AS BIGINT) WHERE a.kind = 'map'",
    "b_body": "SELECT e.eid AS eid, e.eid || '#requestBody' AS body_id, c.id AS root_id FROM b_endpoint e JOIN b_component c ON c.ord = e.ord WHERE e.method <> 'GET'",
    "b_response": "SELECT e.eid AS eid, '200' AS status, e.eid || '#response:200' AS response_id, c.id AS root_id FROM b_endpoint e JOIN b_component c ON c.ord = CAST(floor(e.ord / 2) AS BIGINT)",
    "b_parameter": """SELECT e.eid || '#param:query:' || p.name AS id, e.eid AS eid, p.name AS name, p.location AS location, p.required AND e.ord % 2 = 0 AS required, p.type AS type, p.format AS format
        FROM b_endpoint e CROSS JOIN (SELECT 'limit' AS name, 'query' AS location, false AS required, 'integer' AS type, '' AS format UNION ALL SELECT 'since', 'query', true, 'string', 'date-time'
        UNION ALL SELECT 'filter', 'query', false, 'string', '' UNION ALL SELECT 'site_ids', 'query', false, 'string', '' UNION ALL SELECT 'id', 'path', true, 'string', '' UNION ALL SELECT 'sort', 'query', false, 'string', '') p""",
    "b_cli": "SELECT e.eid || '::show-' || e.tag AS id, e.eid AS eid, 'show ' || e.tag AS command, e.summary AS help, '/cli/' || lower(e.category) AS context FROM b_endpoint e WHERE e.ord % 3 = 0",
    "b_call": """SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS call_id, CASE WHEN l_linenumber % 4 = 3 THEN 'GET' ELSE e.method END AS method,
        CASE WHEN l_linenumber % 7 = 6 THEN e.path || '/more' ELSE e.path END AS path, CASE WHEN l_quantity > 25 THEN 'since' ELSE 'limit' END AS query_key,
        's' || CAST(l_suppkey AS STRING) AS body_key, CASE WHEN l_discount > 0.05 THEN 'other' ELSE 's' || CAST(l_suppkey + 1 AS STRING) END AS body_key2 FROM lineitem JOIN b_endpoint e ON e.ord = l_partkey""",
    "b_source_row": """SELECT 'prov' || CAST(l_suppkey % 3 AS STRING) AS provider, 'schemas' AS section, 'P' || CAST(l_partkey AS STRING) AS name, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ord,
        '{"type":"object","flag":"' || l_returnflag || '","status":"' || l_linestatus || '","qty":' || CAST(CAST(l_quantity AS BIGINT) % 4 AS STRING) || '}' AS body FROM lineitem""",
}


def words(sql: str) -> set[str]:
    return set(sql.replace("(", " ").replace(")", " ").replace(",", " ").split())


def tables(spark: SparkSession, sf_dir: str, sql: str | None = None) -> None:
    """The base tables as temporary views; only those that a text names, if one is given."""
    named = set(BASE) if sql is None else words(sql)
    for name in (n for n in BASE if n in named):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def needed(sql: str, kept: Mapping[str, str] | None = None) -> list[str]:
    """The views that a text uses, in order of definition; ``kept``: texts for some views instead of their own."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in (VIEWS | dict(kept or {})).items():
            if name not in found and name in words(text):
                found.add(name)
                todo.append(body)
    return [name for name in VIEWS if name in found]


def frame(spark: SparkSession, sf_dir: str, sql: str, kept: Mapping[str, str] | None = None) -> DataFrame:
    """A view by name, or any SQL over views and base tables; ``kept`` as ``keep`` gives it."""
    text = with_views(f"SELECT * FROM {sql}" if sql in VIEWS else sql, kept=kept)
    tables(spark, sf_dir, text)
    return spark.sql(text)


def keep(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, str]:
    """Views, each written once: their texts over what is written, for ``frame``. A query that names a view many times would group its lines anew each time."""
    kept: dict[str, str] = {}
    for name in names:
        stored = f"kept_{name}_{uuid.uuid4().hex}"
        shared_checkpoint(frame(spark, sf_dir, name, kept)).createOrReplaceTempView(stored)
        kept[name] = f"SELECT * FROM {stored}"
    return kept


def dealt(spark: SparkSession, rows: str) -> str:
    """The rows of a text in an even deal over all tasks: a file of keys may be one split, while the documents made of its rows are much work each."""
    return f"SELECT /*+ REPARTITION({spark.conf.get('spark.sql.shuffle.partitions')}) */ * FROM ({rows}) d"


def with_views(sql: str, recursive: bool = False, kept: Mapping[str, str] | None = None) -> str:
    names, views = needed(sql, kept), VIEWS | dict(kept or {})
    body = sql.strip()
    own = ""
    if body.upper().startswith("WITH "):
        own, body = body[5:], ""
        if own.upper().startswith("RECURSIVE "):
            own, recursive = own[10:], True
    heads = ",\n".join(f"{n} AS ({views[n]})" for n in names)
    if own:
        heads = f"{heads},\n{own}" if heads else own
        return f"WITH {'RECURSIVE ' if recursive else ''}{heads}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{heads}\n{body}" if heads else body
