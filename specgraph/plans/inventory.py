"""Queries of inventory, freshness and topology."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgraph.operators import inventory, topology
from specgraph.plans.bridge import frame
from specgraph.plans.registry import query

AGGREGATED = """g AS (SELECT from_id, to_id, string_agg(from_port, ',' ORDER BY ord, from_port, to_port) AS from_ports, string_agg(to_port, ',' ORDER BY ord, from_port, to_port) AS to_ports,
 coalesce(arg_max(CASE WHEN lag <> '' THEN lag END, CASE WHEN lag <> '' THEN ord END), '') AS lag, arg_min(speed_bps, ord) / 1e9 AS speed_gbps, arg_min(health, ord) AS health,
 arg_min(stp_state, ord) AS stp_state, count(*) AS n_links FROM b_link GROUP BY from_id, to_id)"""
SPLIT = """s AS (SELECT 'CONNECTED_TO' AS kind, from_id AS a, to_id AS b, from_ports, to_ports, lag, speed_gbps FROM g WHERE from_id NOT LIKE 'tpd~_%' ESCAPE '~' AND to_id NOT LIKE 'tpd~_%' ESCAPE '~'
 AND from_id IN (SELECT serial FROM b_device) AND to_id IN (SELECT serial FROM b_device)
 UNION ALL SELECT 'LINKED_TO', from_id, substr(to_id, 5), from_ports, to_ports, lag, speed_gbps FROM g WHERE to_id LIKE 'tpd~_%' ESCAPE '~' AND from_id IN (SELECT serial FROM b_device))"""


@query("SELECT label, count(*) AS n_keys, max(floor(epoch(synced_at)))::BIGINT AS latest FROM (SELECT label, user_id, synced_at FROM (SELECT *, row_number() OVER (PARTITION BY label || '/' || user_id ORDER BY synced_at DESC NULLS LAST) AS n FROM b_sync) x WHERE n = 1) y GROUP BY label")
def ht_7_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT-7, HT-10, HT-11: latest row of each key."""
    rows = frame(spark, sf_dir, "b_sync").withColumn("key", F.concat_ws("/", "label", "user_id"))
    return inventory.upsert(rows, "key", "synced_at").groupBy("label").agg(F.count("*").alias("n_keys"), F.max(F.unix_timestamp("synced_at")).alias("latest"))


@query(
    """SELECT 'ORG_COLLECTION' AS kind, 'org' AS a, id AS b FROM b_collection UNION ALL SELECT 'COLLECTION_SITE', collection_id, id FROM b_site WHERE collection_id IN (SELECT id FROM b_collection)
    UNION ALL SELECT 'ORG_SITE', 'org', id FROM b_site WHERE collection_id NOT IN (SELECT id FROM b_collection) UNION ALL SELECT 'SITE_DEVICE', site_id, serial FROM b_device WHERE site_id IN (SELECT id FROM b_site)
    UNION ALL SELECT 'GROUP_DEVICE', group_id, serial FROM b_device WHERE group_id IN (SELECT id FROM b_group)"""
)
def ht_1_hierarchy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT-1."""
    return inventory.hierarchy_edges(*(frame(spark, sf_dir, f"b_{t}") for t in ("collection", "site", "device", "group")))


@query("SELECT d.serial, s.name AS site_name, c.name AS collection_name, g.name AS group_name FROM b_device d LEFT JOIN b_site s ON s.id = d.site_id LEFT JOIN b_collection c ON c.id = s.collection_id LEFT JOIN b_group g ON g.id = d.group_id")
def ht_2_scope_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT-2."""
    return inventory.scope_chain(*(frame(spark, sf_dir, f"b_{t}") for t in ("device", "site", "collection", "group")))


@query("SELECT kind, id, name FROM (SELECT 'site' AS kind, id, name FROM b_site UNION ALL SELECT 'collection', id, name FROM b_collection UNION ALL SELECT 'group', id, name FROM b_group) x WHERE contains(lower(name), 'a')")
def ht_3_scopes_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT-3: names over the three scope tables."""
    tables = [frame(spark, sf_dir, f"b_{k}").select(F.lit(k).alias("kind"), "id", "name") for k in ("site", "collection", "group")]
    return tables[0].unionByName(tables[1]).unionByName(tables[2]).where(F.lower("name").contains("a"))


@query(f"WITH {AGGREGATED} SELECT d.serial, count(*) AS n_neighbours, min(g.to_id) AS first_neighbour FROM b_device d JOIN g ON g.from_id = d.serial JOIN b_site s ON s.id = d.site_id GROUP BY d.serial")
def ht_3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT-3: link neighbours of devices at known sites."""
    devices = frame(spark, sf_dir, "b_device").join(frame(spark, sf_dir, "b_site").select(F.col("id").alias("site_id")), "site_id", "left_semi")
    links = inventory.aggregate_links(frame(spark, sf_dir, "b_link")).withColumnRenamed("from_id", "serial")
    return devices.select("serial").join(links, "serial").groupBy("serial").agg(F.count("*").alias("n_neighbours"), F.min("to_id").alias("first_neighbour"))


@query(
    """WITH p AS (SELECT d.*, s.collection_id FROM b_device d JOIN b_site s ON s.id = d.site_id) SELECT 'collection' AS scope, collection_id AS id, count(DISTINCT site_id) AS n_sites, count(DISTINCT serial) AS n_devices FROM p GROUP BY collection_id
    UNION ALL SELECT 'group', group_id, count(DISTINCT site_id), count(DISTINCT serial) FROM p GROUP BY group_id"""
)
def ht_4_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT-4."""
    return inventory.blast_radius(frame(spark, sf_dir, "b_site"), frame(spark, sf_dir, "b_device"))


PORTS = "SELECT DISTINCT from_id AS serial, from_port AS number FROM b_link"
RADIOS = "SELECT DISTINCT to_id AS serial, to_port AS number FROM b_link"


@query(f"SELECT 'HAS_PORT' AS kind, p.serial AS a, p.serial || ':' || p.number AS b FROM ({PORTS}) p JOIN b_device d ON d.serial = p.serial AND d.device_type = 'SWITCH' UNION ALL SELECT 'HAS_RADIO', r.serial, r.serial || ':' || r.number FROM ({RADIOS}) r JOIN b_device d ON d.serial = r.serial AND d.device_type = 'AP'")
def ht_5_ports_and_radios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT-5."""
    return inventory.ports_and_radios(frame(spark, sf_dir, "b_device"), frame(spark, sf_dir, PORTS), frame(spark, sf_dir, RADIOS))


PROFILES = "SELECT 'sup:' || CAST(s_suppkey AS STRING) AS profile_id, CASE s_suppkey % 4 WHEN 0 THEN 'org' WHEN 1 THEN 'collection' WHEN 2 THEN 'site' ELSE 'group' END AS scope_kind, CASE s_suppkey % 4 WHEN 1 THEN CAST(s_suppkey % 7 AS STRING) WHEN 2 THEN CAST(s_suppkey % 30 AS STRING) WHEN 3 THEN 'BUILDING' ELSE 'org' END AS scope_id FROM supplier"


@query(f"SELECT * FROM ({PROFILES}) p WHERE scope_kind = 'org' OR (scope_kind = 'collection' AND scope_id IN (SELECT id FROM b_collection)) OR (scope_kind = 'site' AND scope_id IN (SELECT id FROM b_site)) OR (scope_kind = 'group' AND scope_id IN (SELECT id FROM b_group))")
def ht_6_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT-6."""
    return inventory.assignments(frame(spark, sf_dir, PROFILES), {k: frame(spark, sf_dir, f"b_{k}") for k in ("collection", "site", "group")})


@query(f"WITH {AGGREGATED} SELECT * FROM g")
def ht_8_link_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT-8."""
    return inventory.aggregate_links(frame(spark, sf_dir, "b_link"))


@query(f"WITH {AGGREGATED}, {SPLIT} SELECT * FROM s")
def ht_9_split_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT-9."""
    return inventory.split_links(inventory.aggregate_links(frame(spark, sf_dir, "b_link")), frame(spark, sf_dir, "b_device"))


@query(f"WITH {AGGREGATED}, {SPLIT} SELECT DISTINCT b AS mac FROM s WHERE kind = 'LINKED_TO'")
def ht_9_unmanaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT-9: nodes of the unmanaged ends."""
    return inventory.unmanaged_devices(ht_9_split_links(spark, sf_dir))


@query(f"WITH {AGGREGATED} SELECT 'no_lag' AS finding, from_id, to_id FROM g WHERE lag = '' UNION ALL SELECT 'unhealthy', from_id, to_id FROM g WHERE health NOT IN ('', 'Good') UNION ALL SELECT 'stp', from_id, to_id FROM g WHERE stp_state NOT IN ('', 'FORWARDING')")
def ta_4_link_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TA-4."""
    return inventory.link_findings(inventory.aggregate_links(frame(spark, sf_dir, "b_link")))


@query("SELECT site_id, device_type, status, count(*) AS n FROM b_device GROUP BY ALL")
def ag_23_device_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-23."""
    return inventory.device_counts(frame(spark, sf_dir, "b_device"))


@query("SELECT firmware, count(*) AS n, count_if(status = 'OFFLINE') AS n_offline FROM b_device GROUP BY firmware")
def ag_23_firmware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-23: firmware histogram and offline devices."""
    return frame(spark, sf_dir, "b_device").groupBy("firmware").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "OFFLINE").alias("n_offline"))


NOW = "(SELECT max(ts) FROM events)"


@query(f"SELECT count(*) AS n_stale FROM b_sync WHERE synced_at IS NULL OR floor(epoch({NOW})) - floor(epoch(synced_at)) > 900")
def ag_24_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-24: rows unstamped or older than 15 minutes; "now" is the latest event."""
    return ag_25_freshness(spark, sf_dir).agg(F.sum("n_stale").alias("n_stale"))


@query(
    f"SELECT label, count(*) AS n_rows, count_if(synced_at IS NULL) AS n_unstamped, max(floor(epoch({NOW})) - floor(epoch(synced_at)))::BIGINT AS max_age_s, count_if(synced_at IS NULL OR floor(epoch({NOW})) - floor(epoch(synced_at)) > 900) AS n_stale FROM b_sync GROUP BY label"
)
def ag_25_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-25."""
    now = frame(spark, sf_dir, "SELECT max(ts) AS now FROM events")
    return inventory.freshness(frame(spark, sf_dir, "b_sync").crossJoin(F.broadcast(now)).withColumnRenamed("now", "_now"), F.col("_now"))  # one row


SIMPLE = "e AS (SELECT DISTINCT site_id, least(u, v) AS u, greatest(u, v) AS v FROM b_site_edge WHERE u <> v)"
REACH = f"{SIMPLE}, both_ways AS (SELECT site_id, u, v FROM e UNION ALL SELECT site_id, v, u FROM e), r AS (SELECT site_id, node, node AS low FROM b_site_node UNION SELECT b.site_id, b.v, r.low FROM r JOIN both_ways b ON b.site_id = r.site_id AND b.u = r.node)"


@query(f"WITH RECURSIVE {REACH} SELECT site_id, node, min(low) AS component FROM r GROUP BY site_id, node")
def ta_1_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TA-1: component of every node, for graphs of any size."""
    return topology.site_components(frame(spark, sf_dir, "b_site_node"), frame(spark, sf_dir, "b_site_edge"))


@query(
    f"""WITH RECURSIVE {REACH}, c AS (SELECT site_id, node, min(low) AS component FROM r GROUP BY site_id, node) SELECT n.site_id, n.n_nodes, coalesce(m.n_edges, 0) AS n_edges, n.n_components, n.n_components = 1 AS connected
    FROM (SELECT site_id, count(*) AS n_nodes, count(DISTINCT component) AS n_components FROM c GROUP BY site_id) n LEFT JOIN (SELECT site_id, count(*) AS n_edges FROM e GROUP BY site_id) m ON m.site_id = n.site_id"""
)
def ta_1_site_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TA-1, for sites of any size."""
    return topology.site_counts(frame(spark, sf_dir, "b_site_node"), frame(spark, sf_dir, "b_site_edge"))


@query()
def ta_2_3_site_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TA-2, TA-3: all figures of every site; ``ta_2_path_lengths``, ``ta_3_bridges`` and ``ta_3_cut_nodes`` have SQL for connected sites."""
    return topology.site_metrics(frame(spark, sf_dir, "b_site_node"), frame(spark, sf_dir, "b_site_edge"))


#: Every site as a ring of its customers.
RING = """SELECT CAST(c_nationkey AS STRING) AS site_id, CAST(c_custkey AS BIGINT) AS u, CAST(coalesce(lead(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey), min(c_custkey) OVER (PARTITION BY c_nationkey)) AS BIGINT) AS v FROM customer"""


@query(
    """SELECT site_id, n AS n_nodes, CASE WHEN n > 2 THEN n ELSE n - 1 END AS n_edges, 1::BIGINT AS n_components, true AS connected, (n // 2)::BIGINT AS diameter,
    CASE WHEN n = 1 THEN 0.0 WHEN n % 2 = 0 THEN round(n * n / (4.0 * (n - 1)), 2) ELSE (n + 1) / 4.0 END::DOUBLE AS avg_path FROM (SELECT site_id, count(*) AS n FROM b_site_node GROUP BY site_id) x"""
)
def ta_2_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TA-1, TA-2: path lengths of connected sites: rings, whose lengths a formula gives."""
    return topology.site_metrics(frame(spark, sf_dir, "b_site_node"), frame(spark, sf_dir, RING)).drop("bridges", "cut_nodes")


#: Every site as one network: customers in a tree of two branches each, with links across it for one customer in four.
WEB = """SELECT site_id, u, v FROM (SELECT a.site_id, a.node AS u, b.node AS v FROM ranked a JOIN ranked b ON b.site_id = a.site_id AND (b.r = CAST(floor((a.r - 1) / 2) AS BIGINT) OR (a.r % 8 = 5 AND b.r = a.r - 3) OR (a.r % 8 = 6 AND b.r = CAST(floor(a.r / 4) AS BIGINT))) WHERE a.r > 0) w"""
RANKED = "ranked AS (SELECT CAST(c_nationkey AS STRING) AS site_id, CAST(c_custkey AS BIGINT) AS node, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS r FROM customer)"
_LINKS = f"{RANKED}, e AS (SELECT DISTINCT site_id, least(u, v) AS u, greatest(u, v) AS v FROM ({WEB}) w WHERE u <> v), w AS (SELECT site_id, u AS a, v AS b FROM e UNION ALL SELECT site_id, v, u FROM e)"


#: The same rows by the ranks that each customer is linked to: the join of ``WEB`` has no rank to meet on and compares all pairs of a site.
_LINKED = """SELECT a.site_id, a.u, b.node AS v FROM (SELECT site_id, node AS u, explode(array_distinct(array_compact(array(CAST(floor((r - 1) / 2) AS BIGINT), CASE WHEN r % 8 = 5 THEN r - 3 END, CASE WHEN r % 8 = 6 THEN CAST(floor(r / 4) AS BIGINT) END)))) AS r FROM ranked WHERE r > 0) a
    JOIN ranked b ON b.site_id = a.site_id AND b.r = a.r"""


def _web(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return frame(spark, sf_dir, "b_site_node"), frame(spark, sf_dir, f"WITH {RANKED} {_LINKED}")


@query(
    f"""WITH RECURSIVE {_LINKS}, r AS (SELECT site_id, u, v, u AS node FROM e UNION SELECT r.site_id, r.u, r.v, w.b FROM r JOIN w ON w.site_id = r.site_id AND w.a = r.node AND NOT (least(w.a, w.b) = r.u AND greatest(w.a, w.b) = r.v))
    SELECT e.site_id, e.u, e.v FROM e WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.site_id = e.site_id AND r.u = e.u AND r.v = e.v AND r.node = e.v)"""
)
def ta_3_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TA-3: links without which a site falls apart; the SQL takes each link away in turn."""
    return topology.bridges(topology.blocks(*_web(spark, sf_dir))[0])


@query(
    f"""WITH RECURSIVE {_LINKS}, r AS (SELECT site_id, a AS gone, min(b) AS node FROM w GROUP BY ALL UNION SELECT r.site_id, r.gone, w.b FROM r JOIN w ON w.site_id = r.site_id AND w.a = r.node AND w.b <> r.gone)
    SELECT x.site_id, x.gone AS node FROM (SELECT site_id, gone, count(*) AS n FROM r GROUP BY ALL) x JOIN (SELECT site_id, count(*) AS n FROM ranked GROUP BY site_id) s ON s.site_id = x.site_id WHERE x.n < s.n - 1"""
)
def ta_3_cut_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TA-3: nodes without which a site falls apart; the SQL takes each node away in turn."""
    return topology.cut_nodes(topology.blocks(*_web(spark, sf_dir))[0])


@query(
    f"""WITH RECURSIVE {_LINKS}, r AS (SELECT site_id, node AS start, node, 0 AS d FROM ranked UNION SELECT r.site_id, r.start, w.b, r.d + 1 FROM r JOIN w ON w.site_id = r.site_id AND w.a = r.node WHERE r.d < 2 * floor(log2((SELECT max(r) FROM ranked) + 1)))
    SELECT site_id, max(d)::BIGINT AS far, sum(d)::BIGINT AS steps FROM (SELECT site_id, start, node, min(d) AS d FROM r GROUP BY ALL) x GROUP BY site_id"""
)
def ta_2_path_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TA-2: the longest shortest path of every site, and the sum of all."""
    return topology.path_lengths(*_web(spark, sf_dir))


#: Links with kinds, siblings, ports without a name and ends that are missing.
ODD_LINKS = "SELECT CASE WHEN ord % 31 = 0 THEN '' ELSE from_id END AS from_id, CASE WHEN ord % 29 = 0 THEN NULL ELSE to_id END AS to_id, ord, CASE WHEN ord % 4 = 0 THEN '' ELSE from_port END AS from_port, CASE WHEN ord % 5 = 0 THEN NULL ELSE to_port END AS to_port, speed_bps, lag, health, stp_state, CASE ord % 3 WHEN 0 THEN 'LLDP' WHEN 1 THEN 'mesh' END AS edge_type, CASE ord % 7 WHEN 0 THEN true WHEN 1 THEN false END AS is_sibling FROM b_link"


@query(
    f"""SELECT from_id, to_id, coalesce(string_agg(nullif(from_port, ''), ',' ORDER BY ord), '') AS from_ports, coalesce(string_agg(nullif(to_port, ''), ',' ORDER BY ord), '') AS to_ports, coalesce(arg_max(nullif(lag, ''), ord) FILTER (lag <> ''), '') AS lag, arg_min(speed_bps, ord) / 1e9 AS speed_gbps, arg_min(health, ord) AS health, arg_min(stp_state, ord) AS stp_state,
    count(*) AS n_links, coalesce(arg_min(coalesce(edge_type, ''), ord), '') AS edge_type, coalesce(arg_min(coalesce(is_sibling, false), ord), false) AS is_sibling FROM ({ODD_LINKS}) x WHERE from_id <> '' AND to_id <> '' GROUP BY from_id, to_id"""
)
def ht_8_odd_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HT-8: kinds of links and siblings as well, with nameless ports and ends that are missing."""
    return inventory.aggregate_links(frame(spark, sf_dir, ODD_LINKS))
