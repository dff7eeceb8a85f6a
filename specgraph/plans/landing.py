"""Queries of landed feeds and written tables: inventory rows from JSON items, categories, typed, flattened and overlay tables read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specgraph.operators import inventory, projection, specs
from specgraph.operators.walk import scratch_folder, shared_checkpoint
from specgraph.plans.audits import GATES, ag_18_gates
from specgraph.plans.bridge import dealt, frame
from specgraph.plans.registry import query
from specgraph.plans.semantics import MAPPED
from specgraph.plans.specs import ASK, LINES, METHOD, OWN, PARTS, PATH, POOLED, PROVIDER, SOURCE
from specgraph.plans.specs import documents as spec_documents
from specgraph.sources import documents, sinks


def latest(rows: str, key: str, columns: str, order: str = "ord") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order} DESC) AS k FROM ({rows}) r WHERE {key} <> '') x WHERE k = 1"


# --- scopes and devices -------------------------------------------------------------------------------------------------------

VISITS = "SELECT CAST(o_orderkey AS BIGINT) AS ord, c_custkey AS c, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, o_orderstatus AS status, o_orderpriority AS priority FROM orders JOIN customer ON o_custkey = c_custkey"
DEVICES = f"""SELECT ord, CASE ord % 4 WHEN 0 THEN '{{"serialNumber":"C' || CAST(c AS STRING) || '","deviceName":"' || name || '","deviceType":"SWITCH","siteId":' || CAST(nation AS STRING) || ',"deviceGroupId":"' || segment || '","status":"' || status || '","firmwareVersion":"' || priority || '","macAddress":"m' || CAST(c AS STRING) || '"}}'
    WHEN 1 THEN '{{"serial":"C' || CAST(c AS STRING) || '","name":"old ' || name || '","device_type":"AP","site_id":"' || CAST(nation AS STRING) || '","status":null,"firmware":"' || priority || '","ip_address":"10.0.0.' || CAST(c % 250 AS STRING) || '"}}'
    WHEN 2 THEN '{{"serialNumber":"","name":"nobody"}}' ELSE '{{"serialNumber":"C' || CAST(c AS STRING) || '","model":"M' || CAST(nation AS STRING) || '","siteId":null}}' END AS item FROM ({VISITS}) v"""
DEVICE_ROWS = f"""SELECT ord, CASE WHEN ord % 4 = 2 THEN '' ELSE 'C' || CAST(c AS STRING) END AS serial, CASE ord % 4 WHEN 0 THEN name WHEN 1 THEN 'old ' || name ELSE '' END AS name, CASE WHEN ord % 4 = 0 THEN 'm' || CAST(c AS STRING) ELSE '' END AS mac, CASE WHEN ord % 4 = 3 THEN 'M' || CAST(nation AS STRING) ELSE '' END AS model,
    CASE ord % 4 WHEN 0 THEN 'SWITCH' WHEN 1 THEN 'AP' ELSE '' END AS device_type, CASE WHEN ord % 4 = 0 THEN status ELSE '' END AS status, CASE WHEN ord % 4 = 1 THEN '10.0.0.' || CAST(c % 250 AS STRING) ELSE '' END AS ipv4, CASE WHEN ord % 4 < 2 THEN priority ELSE '' END AS firmware,
    CASE WHEN ord % 4 < 2 THEN CAST(nation AS STRING) ELSE '' END AS site_id, CASE WHEN ord % 4 = 0 THEN segment ELSE '' END AS group_id FROM ({VISITS}) v"""
SHOWN = "serial, name, mac, model, device_type, status, ipv4, firmware, site_id, group_id"


@query(latest(DEVICE_ROWS, "serial", SHOWN))
def ht_7_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT-7: devices from landed items under old and new field names; the latest row wins, rows without a serial are left out."""
    return inventory.scope_rows(frame(spark, sf_dir, DEVICES), "device", "ord").select(*SHOWN.split(", "))


@query(latest(f"SELECT * FROM ({DEVICE_ROWS}) d WHERE site_id = '7' AND group_id = 'BUILDING'", "serial", SHOWN))
def ht_7_devices_of_one_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT-7: the same under a site and a group filter."""
    return inventory.scope_rows(frame(spark, sf_dir, DEVICES), "device", "ord", "7", "BUILDING").select(*SHOWN.split(", "))


PLACES = """SELECT CAST(s_suppkey AS BIGINT) AS ord, s_suppkey % 29 AS s, s_nationkey AS nation, s_name AS name FROM supplier"""
SITES = f"""SELECT ord, CASE ord % 3 WHEN 0 THEN '{{"id":' || CAST(s AS STRING) || ',"scopeName":"' || name || '","latitude":"1.5","longitude":2,"collectionId":' || CAST(nation AS STRING) || ',"timezone":{{"timezoneId":"Zone/' || CAST(nation AS STRING) || '"}},"deviceCount":7}}'
    WHEN 1 THEN '{{"scopeId":"' || CAST(s AS STRING) || '","name":"' || name || '","lat":3,"timezone":"UTC","collection_id":null,"device_count":"8","city":"C"}}' ELSE '{{"name":"none"}}' END AS item FROM ({PLACES}) p"""


@query(
    latest(
        f"""SELECT ord, CASE WHEN ord % 3 = 2 THEN '' ELSE CAST(s AS STRING) END AS id, CASE WHEN ord % 3 = 2 THEN 'none' ELSE name END AS name, CASE WHEN ord % 3 = 1 THEN 'C' ELSE '' END AS city, CASE ord % 3 WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END AS lat, CASE WHEN ord % 3 = 0 THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS lon,
        CASE ord % 3 WHEN 0 THEN 7::BIGINT WHEN 1 THEN 8::BIGINT ELSE 0::BIGINT END AS device_count, CASE WHEN ord % 3 = 0 THEN CAST(nation AS STRING) ELSE '' END AS collection_id, CASE ord % 3 WHEN 0 THEN 'Zone/' || CAST(nation AS STRING) WHEN 1 THEN 'UTC' ELSE '' END AS timezone FROM ({PLACES}) p""",
        "id", "id, name, city, lat, lon, device_count, collection_id, timezone",
    )
)
def ht_7_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT-7: sites, with ids as numbers or text and timezones as text or objects."""
    return inventory.scope_rows(frame(spark, sf_dir, SITES), "site", "ord").select("id", "name", "city", "lat", "lon", "device_count", "collection_id", "timezone")


SCOPES = """SELECT CAST(p_partkey AS BIGINT) AS ord, p_size AS n, p_brand AS brand, p_type AS maker FROM part"""
SCOPE_ITEMS = f"""SELECT ord, CASE WHEN ord % 2 = 0 THEN '{{"id":"' || brand || '","scopeName":"' || maker || '","siteCount":' || CAST(n AS STRING) || '}}' ELSE '{{"scopeId":"' || brand || '","name":"' || maker || '","device_count":' || CAST(n AS STRING) || '}}' END AS item FROM ({SCOPES}) s"""


@query(
    latest(f"SELECT ord, 'collection' AS label, brand AS id, maker AS name, CASE WHEN ord % 2 = 0 THEN n ELSE 0 END::BIGINT AS site_count, CASE WHEN ord % 2 = 0 THEN 0 ELSE n END::BIGINT AS device_count FROM ({SCOPES}) s", "id", "label, id, name, site_count, device_count")
    + " UNION ALL "
    + latest(f"SELECT ord, 'group' AS label, brand AS id, maker AS name, 0::BIGINT AS site_count, CASE WHEN ord % 2 = 0 THEN 0 ELSE n END::BIGINT AS device_count FROM ({SCOPES}) s", "id", "label, id, name, site_count, device_count")
)
def ht_7_collections_and_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT-7: collections and groups."""
    items = frame(spark, sf_dir, SCOPE_ITEMS)
    collections = inventory.scope_rows(items, "collection", "ord").select(F.lit("collection").alias("label"), "id", "name", "site_count", "device_count")
    return collections.unionByName(inventory.scope_rows(items, "group", "ord").select(F.lit("group").alias("label"), "id", "name", F.lit(0).cast("long").alias("site_count"), "device_count"))


#: Each line once, with a text that orders lines without ties.
ONCE = "SELECT lpad(CAST(l_orderkey AS STRING), 12, '0') || '/' || lpad(CAST(l_linenumber AS STRING), 3, '0') || '/' || lpad(CAST(l_partkey AS STRING), 12, '0') || '/' || lpad(CAST(l_suppkey AS STRING), 12, '0') AS ord, l_orderkey * 10 + l_linenumber AS line, l_partkey, l_suppkey, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey"
PROFILES = f"SELECT ord, line, l_partkey AS p, l_suppkey AS s, l_returnflag AS flag FROM ({ONCE}) o"
PROFILE_ITEMS = f"""SELECT ord, CASE line % 3 WHEN 0 THEN '{{"id":' || CAST(p AS STRING) || ',"name":"n' || CAST(p AS STRING) || '","isDefault":' || CASE WHEN flag = 'A' THEN 'true' ELSE 'false' END || ',"assignedScopeIds":["' || CAST(s AS STRING) || '"],"scopeId":"' || CAST(s AS STRING) || '"}}'
    WHEN 1 THEN '{{"name":"' || CAST(p AS STRING) || '","is_editable":false,"assigned_device_functions":["AP","' || flag || '"],"object_type":"t"}}' ELSE '{{"scopeId":"x"}}' END AS item FROM ({PROFILES}) p"""


@query(
    latest(
        f"""SELECT ord, CASE WHEN line % 3 = 2 THEN '' ELSE 'roles:' || CAST(p AS STRING) END AS id, CASE WHEN line % 3 = 0 THEN 'n' ELSE '' END || CAST(p AS STRING) AS name, CASE WHEN line % 3 = 0 THEN CAST(s AS STRING) ELSE '' END AS scope_id, CASE WHEN line % 3 = 1 THEN 't' ELSE '' END AS object_type, line % 3 = 0 AND flag = 'A' AS is_default,
        line % 3 <> 1 AS is_editable, false AS device_scope_only, CASE WHEN line % 3 = 0 THEN '["' || CAST(s AS STRING) || '"]' ELSE '[]' END AS assigned_scope_ids, CASE WHEN line % 3 = 1 THEN '["AP","' || flag || '"]' ELSE '[]' END AS assigned_device_functions FROM ({PROFILES}) p""",
        "id", "id, name, scope_id, object_type, is_default, is_editable, device_scope_only, assigned_scope_ids, assigned_device_functions",
    )
)
def ht_10_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT-10: profiles with typed flags and lists as JSON text."""
    return inventory.profile_rows(frame(spark, sf_dir, PROFILE_ITEMS), "roles", "ord").drop("device_function")


FEED = f"SELECT ord, 'C' || CAST(l_suppkey * 5 AS STRING) AS serial, l_partkey % 6 AS n, l_returnflag AS flag, l_linestatus AS status, CAST(l_quantity AS BIGINT) AS q, l_partkey AS p FROM ({ONCE}) o"
PORTS = f"""SELECT ord, serial, '{{' || CASE WHEN n = 0 THEN '' ELSE '"port_number":' || CAST(n AS STRING) || ',' END || '"name":"p' || CAST(n AS STRING) || '","admin_status":"' || flag || '","speed":' || CAST(q AS STRING) || ',"vlan_id":' || CASE WHEN q % 2 = 0 THEN 'null' ELSE CAST(q AS STRING) END || '}}' AS item FROM ({FEED}) f"""
RADIOS = f"""SELECT ord, serial, '{{"index":' || CAST(n % 3 AS STRING) || ',"band":"' || flag || '","channel":' || CAST(q AS STRING) || ',"utilization":' || CAST(q AS STRING) || '.5,"radio_mode":"' || status || '"}}' AS item FROM ({FEED}) f"""


@query(latest(f"SELECT ord, 'port' AS kind, serial || ':' || CAST(n AS STRING) AS id, n::BIGINT AS number, 'p' || CAST(n AS STRING) AS name, flag AS status, CAST(q AS STRING) AS speed, CASE WHEN q % 2 = 0 THEN 0 ELSE q END::BIGINT AS vlan_or_channel FROM ({FEED}) f", "id", "kind, id, number, name, status, speed, vlan_or_channel")
       + " UNION ALL " + latest(f"SELECT ord, 'radio' AS kind, serial || ':' || CAST(n % 3 AS STRING) AS id, (n % 3)::BIGINT AS number, flag AS name, status, CAST(q AS STRING) || '.5' AS speed, q::BIGINT AS vlan_or_channel FROM ({FEED}) f", "id", "kind, id, number, name, status, speed, vlan_or_channel"))
def ht_11_ports_and_radios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT-11: ports and radios from landed items; a port without a number is number 0."""
    ports = inventory.part_rows(frame(spark, sf_dir, PORTS), "port", "serial", "ord").select(F.lit("port").alias("kind"), "id", "number", "name", F.col("admin_status").alias("status"), "speed", F.col("vlan_id").alias("vlan_or_channel"))
    radios = inventory.part_rows(frame(spark, sf_dir, RADIOS), "radio", "serial", "ord").select(F.lit("radio").alias("kind"), "id", "number", F.col("band").alias("name"), F.col("mode").alias("status"), F.col("utilization").cast("string").alias("speed"), F.col("channel").alias("vlan_or_channel"))
    return ports.unionByName(radios)


CLIENTS = f"""SELECT ord, '{{"macaddr":"' || CASE WHEN p % 7 = 0 THEN '' ELSE 'aa:' || CAST(p AS STRING) END || '","name":"c' || CAST(p AS STRING) || '","snr":' || CAST(q AS STRING) || CASE WHEN q % 3 = 0 THEN '' ELSE ',"associated_device":"' || serial || '"' END || '}}' AS item FROM ({FEED}) f"""


@query(
    "WITH c AS ("
    + latest(f"SELECT ord, CASE WHEN p % 7 = 0 THEN '' ELSE 'aa:' || CAST(p AS STRING) END AS mac, 'c' || CAST(p AS STRING) AS name, q::DOUBLE AS snr, CASE WHEN q % 3 = 0 THEN '' ELSE serial END AS device FROM ({FEED}) f", "mac", "mac, name, snr, device")
    + ") SELECT c.*, d.serial IS NOT NULL AS has_edge FROM c LEFT JOIN b_device d ON d.serial = c.device"
)
def ht_11_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT-11: clients, and whether a known device has an edge to them."""
    clients = shared_checkpoint(inventory.client_rows(frame(spark, sf_dir, CLIENTS), "ord"))
    edges = inventory.client_edges(clients, frame(spark, sf_dir, "b_device")).select(F.col("b").alias("mac"), F.lit(True).alias("has_edge"))
    return clients.join(edges, "mac", "left").select("mac", "name", "snr", "device", F.coalesce("has_edge", F.lit(False)).alias("has_edge"))


# --- responses ----------------------------------------------------------------------------------------------------------------

BODIES = """SELECT CAST(o_orderkey AS BIGINT) AS page, 'cat' || CAST(o_orderkey % 3 AS STRING) AS category, CASE o_orderkey % 7 WHEN 0 THEN '[{"v":' || CAST(o_custkey AS STRING) || '},{"v":1}]' WHEN 1 THEN '{"items":{"no":"list"},"result":[{"v":' || CAST(o_custkey AS STRING) || '}]}'
    WHEN 2 THEN '{"cat' || CAST(o_orderkey % 3 AS STRING) || '":[{"v":2},{"v":' || CAST(o_custkey AS STRING) || '}]}' WHEN 3 THEN '{"name":"' || CAST(o_custkey AS STRING) || '"}' WHEN 4 THEN '{"other":[1]}' WHEN 5 THEN '{broken' ELSE '{"items":[],"name":"x"}' END AS body FROM orders"""


@query(
    f"""WITH b AS ({BODIES}), n AS (SELECT CAST(o_orderkey AS BIGINT) AS page, CAST(o_custkey AS STRING) AS c FROM orders) SELECT b.page, category, t.pos, replace(t.item, '@', n.c) AS item FROM b JOIN n ON n.page = b.page
    JOIN (VALUES (0, 0, '{{"v":@}}'), (0, 1, '{{"v":1}}'), (1, 0, '{{"v":@}}'), (2, 0, '{{"v":2}}'), (2, 1, '{{"v":@}}'), (3, 0, '{{"name":"@"}}')) t(k, pos, item) ON t.k = b.page % 7"""
)
def io_7_items_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-7: a list, a list under a fixed name or under the category's, an object with a name; others have no item."""
    return documents.response_items(frame(spark, sf_dir, BODIES), "body", category="category")


ROOTS = """SELECT CAST(c_custkey AS BIGINT) AS root, CASE c_custkey % 5 WHEN 0 THEN '{"categories":["a' || c_mktsegment || '"," ",{"name":"b"}]}' WHEN 1 THEN '[{"category":"c"},{"other":1},"' || c_mktsegment || '"]' WHEN 2 THEN '{"items":"none"}' WHEN 3 THEN NULL ELSE '{"result":[]}' END AS body FROM customer"""


@query(
    """SELECT CAST(c_custkey AS BIGINT) AS root, t.pos, replace(t.category, '@', c_mktsegment) AS category FROM customer JOIN (SELECT k, pos, category FROM (VALUES (0, 0, 'a@'), (0, 1, 'b'), (1, 0, 'c'), (1, 1, '@')) v(k, pos, category)
    UNION ALL SELECT k, pos, category FROM (VALUES (2), (3)) a(k), (VALUES (0, 'wlan-ssids'), (1, 'sw-port-profiles'), (2, 'gw-port-profiles'), (3, 'roles'), (4, 'server-groups'), (5, 'ntp'), (6, 'dns'), (7, 'snmp')) b(pos, category)) t ON t.k = c_custkey % 5"""
)
def io_7_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-7: category names of root responses, with the fixed ones where a root lists none."""
    return documents.categories(frame(spark, sf_dir, ROOTS), "body")


# --- written tables -----------------------------------------------------------------------------------------------------------

COMPONENT = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("body_json", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("deprecated", T.BooleanType()), T.StructField("ord", T.LongType())])
ENDPOINT = T.StructType([T.StructField("eid", T.StringType()), T.StructField("method", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("tag", T.StringType()), T.StructField("deprecated", T.BooleanType()), T.StructField("ord", T.LongType())])
COMPONENT_ROWS = "SELECT id, name, CASE WHEN ord % 5 = 0 THEN NULL ELSE kind END AS kind, CASE WHEN ord % 3 = 0 THEN NULL ELSE body_json END AS body_json, CASE WHEN ord % 2 = 0 THEN NULL ELSE ord END AS ord FROM b_component"
ENDPOINT_ROWS = "SELECT eid, method, CASE WHEN ord % 4 = 0 THEN NULL ELSE summary END AS summary, tag, CASE WHEN ord % 5 = 0 THEN NULL ELSE deprecated END AS deprecated, ord FROM b_endpoint"


def folder(spark: SparkSession) -> str:
    return scratch_folder(spark)


@query(f"SELECT 'component' AS table_name, id AS key, coalesce(kind, '') AS a, coalesce(body_json, '') AS b, false AS flag, 0::INT AS n_tags, ord FROM ({COMPONENT_ROWS}) c UNION ALL SELECT 'endpoint', eid, coalesce(summary, ''), method, coalesce(deprecated, false), NULL, ord FROM ({ENDPOINT_ROWS}) e")
def io_8_written_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-8: typed tables written with fixed schemas, the null rule and unique keys, read back."""
    at = folder(spark)
    sinks.write_table(frame(spark, sf_dir, COMPONENT_ROWS), f"{at}/component", COMPONENT, "id", bucket="id")
    sinks.write_table(frame(spark, sf_dir, ENDPOINT_ROWS), f"{at}/endpoint", ENDPOINT, "eid")
    components = spark.read.parquet(f"{at}/component").select(F.lit("component").alias("table_name"), F.col("id").alias("key"), F.col("kind").alias("a"), F.col("body_json").alias("b"), F.col("deprecated").alias("flag"), F.size("tags").alias("n_tags"), "ord")
    ends = spark.read.parquet(f"{at}/endpoint").select(F.lit("endpoint").alias("table_name"), F.col("eid").alias("key"), F.col("summary").alias("a"), F.col("method").alias("b"), F.col("deprecated").alias("flag"), F.lit(None).cast("int").alias("n_tags"), "ord")
    return components.unionByName(ends)


OPERATION = f"'/paths/' || replace({PATH}, '/', '~1') || '/' || {METHOD}"


@query(
    f"""WITH l AS (SELECT *, {SOURCE} AS source, {OPERATION} AS op FROM ({LINES}) x), p AS (SELECT *, {SOURCE} AS source, '/components/schemas/P' || CAST(part AS STRING) AS place FROM ({PARTS}) x)
    SELECT source, 'Operation' AS kind, op AS pointer, 'op_' || CAST(part AS STRING) || '_' || CAST(n AS STRING) AS name, true AS has_raw, false AS is_extension, 3 AS depth, '' AS scalar FROM l
    UNION ALL SELECT source, 'Parameter', op || '/parameters/0', 'limit', true, false, 5, '' FROM l UNION ALL SELECT source, 'Parameter', op || '/parameters/1', 'since' || CAST(n % 2 AS STRING), true, false, 5, '' FROM l
    UNION ALL SELECT source, 'Extension', place || '/properties/qty/x-path', 'x-path', false, true, 6, '"/m' || CAST(part % 4 AS STRING) || ':top/qty"' FROM p UNION ALL SELECT source, 'Property', place || '/properties/' || v.name, v.name, true, false, 5, '' FROM p CROSS JOIN (VALUES ('qty'), ('sup'), ('all')) v(name)"""
)
def io_9_written_ast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-9, AST-3, AST-4: flattened documents written in buckets of their id and read back: names, raw JSON on meaningful kinds only."""
    at = folder(spark)
    ast = specs.flatten(spec_documents(spark, sf_dir), ("source", *(c.split()[0] for c in specs.AST.split(", "))))
    sinks.write_table(ast, f"{at}/ast", ast.schema, keep_null=frozenset(["parent", "key"]), bucket="spec_id")
    back = spark.read.parquet(f"{at}/ast").where(F.col("kind").isin("Operation", "Parameter", "Property", "Extension"))
    back = back.where((F.col("value_type") == "object") | F.col("is_extension"))
    return back.select("source", "kind", "pointer", "name", (F.col("raw") != "").alias("has_raw"), "is_extension", "depth", "scalar")


@query(
    f"""WITH l AS (SELECT *, {SOURCE} AS source, {OPERATION} AS op FROM ({LINES}) x), p AS (SELECT *, {SOURCE} AS source, '/components/schemas/P' || CAST(part AS STRING) AS place FROM ({PARTS}) x)
    SELECT source, 'Endpoint' AS kind, op AS pointer FROM l UNION ALL SELECT source, 'Parameter', op || '/parameters/' || v.i FROM l CROSS JOIN (VALUES ('0'), ('1')) v(i) UNION ALL SELECT source, 'Schema', op || '/parameters/' || v.i || '/schema' FROM l CROSS JOIN (VALUES ('0'), ('1')) v(i)
    UNION ALL SELECT source, 'Response', op || '/responses/200/content/application~1json' FROM l UNION ALL SELECT source, 'RequestBody', op || '/requestBody/content/application~1json' FROM l WHERE qty > 20
    UNION ALL SELECT source, 'Property', place || '/properties/' || v.name FROM p CROSS JOIN (VALUES ('qty'), ('sup'), ('all')) v(name) UNION ALL SELECT source, 'Schema', place FROM p UNION ALL SELECT DISTINCT source, 'Schema', '/components/schemas/S' || CAST(sup AS STRING) FROM p"""
)
def io_9_written_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-9, SM-1..4: overlay nodes written with their ids as keys and read back, every node."""
    at = folder(spark)
    nodes = shared_checkpoint(specs.overlay_rows(spec_documents(spark, sf_dir)))  # read for its keys and to be written
    sinks.write_table(nodes, f"{at}/nodes", nodes.schema, "node_id", bucket="spec_id")
    return spark.read.parquet(f"{at}/nodes").select("source", "kind", "pointer")


@query(
    f"""SELECT 'v1' AS version, '{{"component":' || (SELECT count(*) FROM b_component) || ',"endpoint":' || (SELECT count(*) FROM b_endpoint) || '}}' AS tables,
    '{{"invariants_passed":' || CAST(invariants_passed AS STRING) || ',"parity_passed":' || CAST(parity_passed AS STRING) || ',"traversal_passed":' || CAST(traversal_passed AS STRING) || '}}' AS gates, invariants_passed AND parity_passed AND traversal_passed AS passed FROM ({GATES}) g"""
)
def io_10_gated_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-10: the manifest with its gates."""
    at = folder(spark)
    sinks.write_table(frame(spark, sf_dir, COMPONENT_ROWS), f"{at}/component", COMPONENT, "id")
    sinks.write_table(frame(spark, sf_dir, ENDPOINT_ROWS), f"{at}/endpoint", ENDPOINT, "eid")
    names = ("invariants_passed", "parity_passed", "traversal_passed")
    gates = ag_18_gates(spark, sf_dir).select(F.explode(F.array(*(F.struct(F.lit(n).alias("gate"), F.col(n).alias("passed")) for n in names))).alias("g")).select("g.gate", "g.passed")
    return sinks.manifest({n: spark.read.parquet(f"{at}/{n}") for n in ("component", "endpoint")}, "v1", gates)


@query(
    f"""WITH d AS (SELECT o, {PROVIDER} AS spec_source, count_if(flag = 'N') > 0 AS lost, o % 11 IN (0, 1) AS failed FROM ({PARTS}) x GROUP BY o)
    SELECT spec_source, count(*) AS n_raw, count_if(failed) AS n_failed, count_if(NOT failed AND NOT lost) AS n_resolved, count_if(NOT failed AND lost) AS n_unresolved, count_if(NOT failed) AS n_overlay,
    round(count_if(NOT failed AND NOT lost) / count(*), 4) AS resolved_ratio, round(count_if(NOT failed) / count(*), 4) AS overlay_ratio FROM d GROUP BY spec_source"""
)
def ag_20_carry_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-20: documents from raw to overlay by provider; some are cut off, some are lists."""
    number = F.col("source").cast("long") % 11
    corpus = spec_documents(spark, sf_dir).withColumn("raw", F.when(number == 0, F.substring("raw", 1, 20)).when(number == 1, F.lit("[1]")).otherwise(F.col("raw")))
    return specs.carried(corpus)


MODULES = "SELECT CAST(p_partkey AS STRING) AS t, p_partkey % 4 AS m, p_size AS n FROM part"


@query(
    f"""WITH p AS (SELECT DISTINCT CASE m WHEN 0 THEN '/mod' || CAST(n AS STRING) || ':top/' || t WHEN 1 THEN '/top/mod' || CAST(n AS STRING) || ':leaf/x:' || t ELSE '/plain/' || t END AS id, CASE WHEN m < 2 THEN 'mod' || CAST(n AS STRING) ELSE '' END AS module FROM ({MODULES}) x WHERE m < 3)
    SELECT 'YangPath' AS kind, id, module FROM p UNION ALL SELECT DISTINCT 'YangModule', module, module FROM p WHERE module <> ''"""
)
def sg_10_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SG-10: model paths and their modules."""
    rows = f"SELECT CASE m WHEN 0 THEN '/mod' || CAST(n AS STRING) || ':top/' || t WHEN 1 THEN '/top/mod' || CAST(n AS STRING) || ':leaf/x:' || t WHEN 2 THEN '/plain/' || t ELSE '' END AS yang_path FROM ({MODULES}) x"
    return projection.yang_rows(frame(spark, sf_dir, f"{rows} UNION ALL {rows}"))


@query(
    f"""SELECT table_name || ':' || row_id || ':' || substr(sha1(table_name || '|' || row_id || '|' || semantic_id || '|' || ast_id || '|' || spec_id || '|' || pointer), 1, 16) AS projection_id, table_name, row_id, semantic_id, ast_id, spec_id, pointer, min(source) AS source, min(status) AS status
    FROM ({MAPPED}) g GROUP BY table_name, row_id, semantic_id, ast_id, spec_id, pointer"""
)
def ag_7_projection_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-7: map rows of all documents, each origin once, with hashed ids; here every row comes twice."""
    rows = frame(spark, sf_dir, MAPPED)
    # both copies of a row are made where it is, so that they meet before the shuffle
    return projection.projection_map(rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("run")))


@query(
    f"""WITH l AS (SELECT *, {SOURCE} AS source, {OPERATION} AS op, '/components/schemas/P' || CAST(part AS STRING) AS target FROM ({LINES}) x)
    SELECT source, 'RETURNS_SCHEMA' AS kind, op AS a, target AS b, '{{"status":"200","media":"application/json"}}' AS evidence FROM l UNION ALL SELECT source, 'ACCEPTS_SCHEMA', op, target, '{{"status":"","media":"application/json"}}' FROM l WHERE qty > 20"""
)
def sm_7_edges_with_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-7: every edge from an operation to a schema with its evidence; both ends are found among the overlay's nodes."""
    corpus = shared_checkpoint(spec_documents(spark, sf_dir))
    ast = shared_checkpoint(specs.flatten(corpus))
    nodes = specs.semantic_nodes(ast).select("node_id", "spec_id", "pointer")
    edges = projection.schema_edges(ast).join(nodes.select(F.col("node_id").alias("source"), "spec_id", F.col("pointer").alias("a")), "source")
    edges = edges.join(nodes.select(F.col("node_id").alias("target"), F.col("pointer").alias("b")), "target").select("spec_id", "kind", "a", "b", "evidence")
    return specs.spec_rows(corpus).select("spec_id", "source").join(edges, "spec_id").drop("spec_id")


UNTIED = POOLED.replace("DESC, ord)", "DESC, ord, body)")


@query(
    f"""SELECT a.source, a.name, CASE WHEN o.body IS NOT NULL AND (p.body IS NULL OR length(o.body) >= length(p.body)) THEN 'own' WHEN p.body IS NOT NULL THEN 'provider' ELSE 'none' END AS scope, coalesce(CASE WHEN o.body IS NOT NULL AND (p.body IS NULL OR length(o.body) >= length(p.body)) THEN o.body ELSE p.body END, '') AS body, count(*) AS n
    FROM ({ASK}) a LEFT JOIN ({OWN}) o ON o.source = a.source AND o.name = a.name LEFT JOIN (SELECT provider, name, body FROM ({UNTIED}) q) p ON p.provider = a.provider AND p.name = a.name GROUP BY ALL"""
)
def jn_2_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-2: the body found for every name asked for, and where."""
    found = projection.resolve_two_scopes(frame(spark, sf_dir, ASK), frame(spark, sf_dir, OWN), frame(spark, sf_dir, UNTIED))
    return found.groupBy("source", "name", "scope", F.coalesce("body", F.lit("")).alias("body")).agg(F.count("*").alias("n"))


#: A file for each supplier: documents, broken ones, one that is no JSON for its bare word, lists, and nests beyond any limit.
_FILES = """SELECT 'prov' || CAST(s_suppkey % 3 AS STRING) AS provider, s_suppkey AS k, CAST(s_suppkey AS STRING) AS t FROM supplier"""
_TEXT = """CASE CAST(k % 7 AS INT) WHEN 1 THEN '{"info":{"title":"cut' WHEN 2 THEN '[{"info":1}]' WHEN 3 THEN '{"a":NaN}' WHEN 4 THEN repeat('{"a":', 5100) || '1' || repeat('}', 5100) WHEN 5 THEN repeat('[', 100000) ELSE '{"info": {"title": "T' || t || '"}, "paths": {"/b": {}, "/a": {"x": ' || t || '}}}' END"""


def landed(spark: SparkSession, sf_dir: str) -> str:
    """The files, written below a new folder by provider."""
    at = scratch_folder(spark, "landed")
    files = frame(spark, sf_dir, f"SELECT provider AS spec_source, 'd' || t || '.json' AS file, {_TEXT} AS value FROM ({dealt(spark, _FILES)}) x")
    # tasks put their own files in place: the other way the driver moves them all, one by one
    files.write.partitionBy("spec_source", "file").option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(at)
    return at


@query(f"SELECT provider AS spec_source, CASE k % 7 WHEN 1 THEN 'broken' WHEN 2 THEN 'not an object' WHEN 3 THEN 'broken' WHEN 4 THEN 'too deep' WHEN 5 THEN 'too deep' ELSE 'ok' END AS status, count(*) AS n FROM ({_FILES}) x GROUP BY ALL")
def io_1_landed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-1: files of each provider by what became of them."""
    return documents.corpus_report(spark, landed(spark, sf_dir))


@query(f"""SELECT provider AS spec_source, provider || '/d' || t || '.json' AS source, 'T' || t AS title, '{{"info":{{"title":"T' || t || '"}},"paths":{{"/b":{{}},"/a":{{"x":' || t || '}}}}}}' AS raw FROM ({_FILES}) x WHERE k % 7 IN (0, 6)""")
def io_1_landed_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IO-1, ST-1: the documents of all providers, read from files."""
    return documents.load_corpus(spark, landed(spark, sf_dir))
