"""Queries of discovery and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgraph.operators import discover, search
from specgraph.operators.walk import labelled_values, reached_counts, scratch_folder, within
from specgraph.plans.bridge import frame
from specgraph.plans.registry import query


def _walk(hops: int, edges: str = "b_composed", name: str = "w", roots: str = "b_body") -> str:
    """Least depth of each node within some hops of each body's root, without recursion on the number of paths."""
    levels = [f"{name}0 AS (SELECT DISTINCT root_id AS root, root_id AS node FROM {roots})"]
    levels += [f"{name}{k} AS (SELECT DISTINCT p.root, e.b AS node FROM {name}{k - 1} p JOIN {edges} e ON e.a = p.node)" for k in range(1, hops + 1)]
    union = " UNION ALL ".join(f"SELECT root, node, {k} AS depth FROM {name}{k}" for k in range(hops + 1))
    return ", ".join(levels) + f", {name} AS (SELECT root, node, min(depth) AS depth FROM ({union}) x GROUP BY root, node)"


FIELDS = f"{_walk(5)}, f AS (SELECT b.eid, w.node AS host_id, w.depth, p.id AS property_id, p.name, p.required, p.read_only, p.device_types, p.yang_path, p.type, p.type_id FROM (SELECT DISTINCT eid, root_id FROM b_body) b JOIN w ON w.root = b.root_id JOIN b_property p ON p.component_id = w.node)"


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.body_fields(frame(spark, sf_dir, "b_body"), frame(spark, sf_dir, "b_composed"), frame(spark, sf_dir, "b_property"))


@query(f"WITH {FIELDS} SELECT eid, host_id, depth, property_id, name, required, type FROM f WHERE device_types IS NULL OR device_types = '' OR list_contains(string_split(device_types, ','), 'SWITCH')")
def jn_13_body_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-13, DQ-2: canonical body fields of every endpoint for one device type."""
    found = _fields(spark, sf_dir).withColumn("device_types", discover.type_list("device_types")).where(discover.device_filter("SWITCH"))
    return found.select("eid", "host_id", F.col("depth").cast("int").alias("depth"), "property_id", "name", "required", "type")


@query(f"WITH {FIELDS} SELECT eid, count(*) AS n_required, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM f WHERE required AND depth = 0 GROUP BY eid")
def jn_15_required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-15, DQ-3: required fields at the top level of a body."""
    own = frame(spark, sf_dir, "b_property").where("required").select(F.col("component_id").alias("root_id"), "name")
    top = frame(spark, sf_dir, "b_body").select("eid", "root_id").distinct().join(own, "root_id")
    return top.groupBy("eid").agg(F.count("*").alias("n_required"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


@query(f"WITH {FIELDS} SELECT eid, CASE WHEN depth = 0 THEN 'direct' ELSE host_id END AS source, count(*) AS n FROM f GROUP BY ALL")
def jn_18_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-18: direct and inherited properties."""
    return _fields(spark, sf_dir).groupBy("eid", F.when(F.col("depth") == 0, "direct").otherwise(F.col("host_id")).alias("source")).agg(F.count("*").alias("n"))


@query("SELECT component_id, count(*) AS n_fields, count_if(NOT read_only) AS n_writable, count_if(required) AS n_required FROM b_property GROUP BY component_id")
def dq_3_writable_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-3."""
    return frame(spark, sf_dir, "b_property").groupBy("component_id").agg(F.count("*").alias("n_fields"), F.count_if(~F.col("read_only")).alias("n_writable"), F.count_if("required").alias("n_required"))


@query("SELECT id, kind FROM b_component WHERE kind IN ('unresolved', 'map')")
def dq_3_odd_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-3: unresolved components and maps."""
    return frame(spark, sf_dir, "b_component").where(F.col("kind").isin("unresolved", "map")).select("id", "kind")


@query("SELECT eid, path FROM b_endpoint WHERE method = 'GET' AND contains(path, 'brand-1') ORDER BY length(path), path LIMIT 20")
def dq_1_get_by_fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-1: the limit is the feature."""
    return frame(spark, sf_dir, "b_endpoint").where("method = 'GET' AND contains(path, 'brand-1')").orderBy(F.length("path"), "path").limit(20).select("eid", "path")


@query("SELECT category, count(*) AS n, count_if(deprecated) AS n_deprecated FROM b_endpoint WHERE method = 'GET' GROUP BY category")
def dq_4_read_only_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-4."""
    return frame(spark, sf_dir, "b_endpoint").where("method = 'GET'").groupBy("category").agg(F.count("*").alias("n"), F.count_if("deprecated").alias("n_deprecated"))


@query("SELECT source, tag, count(*) AS n FROM (SELECT source, unnest(list_value(lang, 'l' || CAST(n_chars % 3 AS STRING))) AS tag FROM documents) x GROUP BY ALL")
def dq_5_by_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-5: rows by tag and source."""
    rows = frame(spark, sf_dir, "SELECT source, array(lang, 'l' || CAST(n_chars % 3 AS STRING)) AS tags FROM documents")
    return rows.select("source", F.explode("tags").alias("tag")).groupBy("source", "tag").agg(F.count("*").alias("n"))


@query("SELECT page_id, octet_length(encode(html)) > 4096 AS truncated, CASE WHEN octet_length(encode(html)) > 4096 THEN substr(html, 1, 200) ELSE html END AS shown, octet_length(encode(html))::BIGINT AS size_bytes FROM pages")
def dq_6_oversize_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DQ-6."""
    return frame(spark, sf_dir, "SELECT page_id, html FROM pages").select("page_id", *discover.oversize("html"))


@query("SELECT eid, name, required FROM b_parameter WHERE location = 'query' OR required")
def jn_14_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-14."""
    return frame(spark, sf_dir, "b_parameter").where("location = 'query' OR required").select("eid", "name", "required")


@query("SELECT c.id, coalesce(a.n, 0) AS n_accepting, coalesce(r.n, 0) AS n_returning FROM b_component c LEFT JOIN (SELECT root_id, count(*) AS n FROM b_body GROUP BY 1) a ON a.root_id = c.id LEFT JOIN (SELECT root_id, count(*) AS n FROM b_response GROUP BY 1) r ON r.root_id = c.id")
def jn_16_accept_and_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-16."""
    counts = [frame(spark, sf_dir, t).groupBy(F.col("root_id").alias("id")).agg(F.count("*").alias(n)) for t, n in (("b_body", "n_accepting"), ("b_response", "n_returning"))]
    return frame(spark, sf_dir, "b_component").select("id").join(counts[0], "id", "left").join(counts[1], "id", "left").na.fill(0)


@query("SELECT a AS id, 'COMPOSED_OF' AS kind, b AS target FROM b_composed UNION ALL SELECT a, 'HAS_VALUE', b FROM b_value UNION ALL SELECT DISTINCT component_id, 'REFERENCES', type_id FROM b_property WHERE type = 'object'")
def jn_17_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-17: one hop of composition, map values and references."""
    edges = [frame(spark, sf_dir, t).select(F.col("a").alias("id"), F.lit(k).alias("kind"), F.col("b").alias("target")) for t, k in (("b_composed", "COMPOSED_OF"), ("b_value", "HAS_VALUE"))]
    refs = frame(spark, sf_dir, "b_property").where("type = 'object'").select(F.col("component_id").alias("id"), F.lit("REFERENCES").alias("kind"), F.col("type_id").alias("target")).distinct()
    return edges[0].unionByName(edges[1]).unionByName(refs)


BOTH = "bv AS (SELECT a, b FROM b_composed UNION SELECT a, b FROM b_value)"
YANG = f"{BOTH}, {_walk(6, 'bv', 'y')}, yang AS (SELECT DISTINCT b.eid, p.yang_path FROM b_body b JOIN y ON y.root = b.root_id JOIN b_property p ON p.component_id = y.node WHERE p.yang_path <> '')"


def _yang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discover.configures_yang(*(frame(spark, sf_dir, f"b_{t}") for t in ("body", "composed", "value", "property")))


@query(f"WITH {YANG} SELECT * FROM yang")
def jn_8_configures_yang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-8: yang paths within six hops of a body."""
    return _yang(spark, sf_dir)


REACHED = "step AS (SELECT a, b FROM b_composed UNION SELECT component_id, type_id FROM b_property WHERE type = 'object'), r AS (SELECT DISTINCT root_id AS root, root_id AS node FROM b_body UNION SELECT r.root, step.b FROM r JOIN step ON step.a = r.node)"


def _steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Roots of bodies, and composition and references."""
    edges = frame(spark, sf_dir, "SELECT a, b FROM b_composed UNION SELECT component_id, type_id FROM b_property WHERE type = 'object'")
    return frame(spark, sf_dir, "SELECT DISTINCT root_id AS root FROM b_body"), edges


@query(f"WITH RECURSIVE {REACHED} SELECT root, count(*) AS n_reached FROM r GROUP BY root")
def jn_3_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-3: components that a body's root reaches over composition and references."""
    return reached_counts(*_steps(spark, sf_dir))


@query(f"WITH RECURSIVE {REACHED} SELECT DISTINCT b.eid, p.yang_path FROM b_body b JOIN r ON r.root = b.root_id JOIN b_property p ON p.component_id = r.node WHERE p.yang_path <> ''")
def jn_9_yang_by_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-9: yang paths of everything a body refers to."""
    paths = frame(spark, sf_dir, "b_property").where("yang_path <> ''").select(F.col("component_id").alias("node"), F.col("yang_path").alias("value"))
    roots = frame(spark, sf_dir, "b_body").select(F.col("eid").alias("label"), F.col("root_id").alias("node"))
    return labelled_values(roots, _steps(spark, sf_dir)[1], paths).select(F.col("label").alias("eid"), F.col("value").alias("yang_path"))


@query(f"WITH {YANG}, n AS (SELECT yang_path, count(DISTINCT component_id) AS n_components FROM b_property WHERE yang_path <> '' GROUP BY yang_path) SELECT n.yang_path, regexp_extract(n.yang_path, '(?:^|/)([^/:]*):', 1) AS module, n.n_components, count(yang.eid) AS n_endpoints FROM n LEFT JOIN yang ON yang.yang_path = n.yang_path GROUP BY ALL")
def jn_19_yang_to_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-19, SG-10: modules, components and endpoints of each yang path."""
    own = frame(spark, sf_dir, "b_property").where("yang_path <> ''").groupBy("yang_path").agg(F.countDistinct("component_id").alias("n_components"))
    used = _yang(spark, sf_dir).groupBy("yang_path").agg(F.count("*").alias("n_endpoints"))
    return own.join(used, "yang_path", "left").select("yang_path", discover.yang_module(F.col("yang_path")).alias("module"), "n_components", F.coalesce("n_endpoints", F.lit(0)).alias("n_endpoints"))


@query("SELECT eid, command FROM b_cli WHERE contains(lower(command), 'eco') OR contains(lower(help), 'eco') OR contains(lower(context), 'eco')")
def jn_20_cli_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-20."""
    hit = [F.contains(F.lower(c), F.lit("eco")) for c in ("command", "help", "context")]
    return frame(spark, sf_dir, "b_cli").where(hit[0] | hit[1] | hit[2]).select("eid", "command")


@query(
    f"""WITH {YANG} SELECT e.eid, coalesce(p.v, '') AS parameters, coalesce(b.v, '') AS bodies, coalesce(r.v, '') AS responses, coalesce(y2.v, '') AS yang, coalesce(c.v, '') AS cli FROM b_endpoint e
    LEFT JOIN (SELECT eid, string_agg(DISTINCT location || ':' || name, ',' ORDER BY location || ':' || name) AS v FROM b_parameter GROUP BY eid) p ON p.eid = e.eid
    LEFT JOIN (SELECT eid, string_agg(DISTINCT root_id, ',' ORDER BY root_id) AS v FROM b_body GROUP BY eid) b ON b.eid = e.eid
    LEFT JOIN (SELECT eid, string_agg(DISTINCT status || ':' || root_id, ',' ORDER BY status || ':' || root_id) AS v FROM b_response GROUP BY eid) r ON r.eid = e.eid
    LEFT JOIN (SELECT eid, string_agg(DISTINCT yang_path, ',' ORDER BY yang_path) AS v FROM yang GROUP BY eid) y2 ON y2.eid = e.eid
    LEFT JOIN (SELECT eid, string_agg(DISTINCT command, ',' ORDER BY command) AS v FROM b_cli GROUP BY eid) c ON c.eid = e.eid"""
)
def jn_21_endpoint_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-21."""
    return discover.endpoint_context(*(frame(spark, sf_dir, f"b_{t}") for t in ("endpoint", "parameter", "body", "response")), _yang(spark, sf_dir), frame(spark, sf_dir, "b_cli"))


@query(
    """SELECT c.id, coalesce(p.n, 0) AS n_properties, coalesce(p.names, '') AS names, coalesce(d.v, '') AS composed_of, coalesce(v.v, '') AS value_of FROM b_component c
    LEFT JOIN (SELECT component_id, count(*) AS n, string_agg(name || ':' || type, ',' ORDER BY name || ':' || type) AS names FROM b_property GROUP BY 1) p ON p.component_id = c.id
    LEFT JOIN (SELECT a, string_agg(b, ',' ORDER BY b) AS v FROM b_composed GROUP BY a) d ON d.a = c.id LEFT JOIN (SELECT a, string_agg(b, ',' ORDER BY b) AS v FROM b_value GROUP BY a) v ON v.a = c.id"""
)
def jn_22_schema_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-22."""
    own = frame(spark, sf_dir, "b_property").groupBy(F.col("component_id").alias("id")).agg(F.count("*").alias("n_properties"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "name", "type"))), ",").alias("names"))
    sides = [frame(spark, sf_dir, t).groupBy(F.col("a").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("b")), ",").alias(n)) for t, n in (("b_composed", "composed_of"), ("b_value", "value_of"))]
    return frame(spark, sf_dir, "b_component").select("id").join(own, "id", "left").join(sides[0], "id", "left").join(sides[1], "id", "left").na.fill(0).na.fill("")


@query("SELECT p.id AS property_id, c.id AS component_id, length(c.body_json)::BIGINT AS n_chars, length(c.body_json) > 60 AS over FROM b_property p JOIN b_component c ON c.id = p.type_id")
def jn_23_bodies_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-23, JN-5: bodies of many ids at once, over-long ones marked."""
    body = frame(spark, sf_dir, "b_component").select(F.col("id").alias("type_id"), F.length("body_json").cast("long").alias("n_chars"))
    return frame(spark, sf_dir, "b_property").join(body, "type_id").select(F.col("id").alias("property_id"), F.col("type_id").alias("component_id"), "n_chars", (F.col("n_chars") > 60).alias("over"))


@query(
    f"""WITH {FIELDS}, q AS (SELECT eid, list(DISTINCT name) AS need FROM b_parameter WHERE location = 'query' AND required GROUP BY eid),
    n AS (SELECT eid, list(DISTINCT name) AS fields, list(DISTINCT name) FILTER (required) AS need_body FROM f GROUP BY eid),
    j AS (SELECT c.*, e.eid IS NOT NULL AS known, q.need, n.fields, n.need_body FROM b_call c LEFT JOIN b_endpoint e ON e.eid = c.method || ':' || c.path LEFT JOIN q ON q.eid = e.eid LEFT JOIN n ON n.eid = e.eid)
    SELECT call_id, known, coalesce(array_to_string(list_sort(list_filter(need, lambda x: x <> query_key)), ','), '') AS missing_query,
    CASE WHEN method = 'POST' THEN coalesce(array_to_string(list_sort(list_filter(need_body, lambda x: x <> body_key AND x <> body_key2)), ','), '') ELSE '' END AS missing_body,
    CASE WHEN method IN ('POST', 'PUT', 'PATCH') AND fields IS NOT NULL THEN coalesce(array_to_string(list_sort(list_filter(list_distinct([body_key, body_key2]), lambda x: NOT list_contains(fields, x))), ','), '') ELSE '' END AS undeclared FROM j"""
)
def jn_24_validate_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-24, EP-2."""
    calls = frame(spark, sf_dir, "b_call").select("call_id", "method", "path", F.array("query_key").alias("query_keys"), F.array("body_key", "body_key2").alias("body_keys"))
    return discover.validate_calls(calls, frame(spark, sf_dir, "b_endpoint"), frame(spark, sf_dir, "b_parameter"), _fields(spark, sf_dir))


SEGMENTS = "SELECT DISTINCT path, unnest(list_filter(list_distinct(string_split(lower(path), '/')), lambda s: length(s) >= 3 AND NOT regexp_matches(s, '^v[0-9]'))) AS segment FROM"


@query(
    f"""WITH u AS ({SEGMENTS} (SELECT DISTINCT path FROM b_call WHERE path NOT IN (SELECT path FROM b_endpoint)) a), l AS (SELECT path, segment FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY length(segment) DESC, segment) AS n FROM u) x WHERE n <= 3),
    k AS (SELECT path AS suggestion, segment FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY length(path), path) AS n FROM ({SEGMENTS} (SELECT DISTINCT path FROM b_endpoint) b) y) z WHERE n <= 5)
    SELECT path, suggestion, "rank" FROM (SELECT path, suggestion, row_number() OVER (PARTITION BY path ORDER BY length(suggestion), suggestion)::INT AS "rank" FROM (SELECT DISTINCT l.path, k.suggestion FROM l JOIN k ON k.segment = l.segment) w) v WHERE "rank" <= 5"""
)
def jn_25_suggest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-25."""
    known = frame(spark, sf_dir, "b_endpoint")
    unknown = frame(spark, sf_dir, "b_call").select("path").distinct().join(known.select("path"), "path", "left_anti")
    return discover.suggest_paths(unknown, known)


PIECES = "SELECT path, segment, row_number() OVER (PARTITION BY path ORDER BY length(segment) DESC, pos) AS n FROM (SELECT path, unnest(string_split(path, '/')) AS segment, generate_subscripts(string_split(path, '/'), 1) AS pos FROM"


@query(
    f"""WITH u AS (SELECT DISTINCT path FROM b_call WHERE path NOT IN (SELECT path FROM b_endpoint)), l AS (SELECT path, segment, n FROM ({PIECES} u) y WHERE segment <> '' AND NOT regexp_matches(segment, '^v[0-9]+([a-z]+[0-9]*)?$', 'i')) z WHERE n <= 3 AND length(segment) >= 3),
    k AS (SELECT segment, method, path AS suggestion FROM (SELECT s.segment, e.method, e.path, row_number() OVER (PARTITION BY s.segment ORDER BY length(e.path), e.path, e.method) AS k FROM (SELECT DISTINCT segment FROM l) s JOIN (SELECT DISTINCT method, path FROM b_endpoint) e ON contains(e.path, s.segment)) x WHERE k <= 5)
    SELECT path, "rank", method, suggestion FROM (SELECT path, method, suggestion, row_number() OVER (PARTITION BY path ORDER BY n, length(suggestion), suggestion, method)::INT AS "rank" FROM (SELECT l.path, k.method, k.suggestion, min(l.n) AS n FROM l JOIN k ON k.segment = l.segment GROUP BY ALL) w) v WHERE "rank" <= 5"""
)
def jn_25_suggest_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-25: endpoints whose paths contain a segment, also inside a longer one."""
    known = frame(spark, sf_dir, "b_endpoint")
    unknown = frame(spark, sf_dir, "b_call").select("path").distinct().join(known.select("path"), "path", "left_anti")
    return discover.suggest_endpoints(unknown, known)


@query(
    """SELECT eid, score FROM (SELECT eid, ord, CASE WHEN contains(path, 'eco') THEN 3 ELSE 0 END + CASE WHEN contains(lower(summary), 'eco') THEN 2 ELSE 0 END + CASE WHEN contains(operation_id, 'eco') THEN 2 ELSE 0 END
    + CASE WHEN contains(tag, 'eco') THEN 2 ELSE 0 END + CASE WHEN contains(lower(category), 'eco') THEN 1 ELSE 0 END AS s1, CASE WHEN contains(path, '-1') THEN 3 ELSE 0 END + CASE WHEN contains(lower(summary), '-1') THEN 2 ELSE 0 END
    + CASE WHEN contains(lower(category), '-1') THEN 1 ELSE 0 END AS s2, (s1 + s2)::BIGINT AS score FROM b_endpoint WHERE NOT deprecated) x WHERE s1 > 0 AND s2 > 0 ORDER BY score DESC, ord LIMIT 40"""
)
def tk_1_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-1: the limit is the feature."""
    return search.keyword_search(frame(spark, sf_dir, "b_endpoint"), ["eco", "-1"]).select("eid", "score")


WORDS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9_]+'), lambda w: w <> '')"


@query(f"SELECT doc, term, count(*) AS tf, max(dl)::BIGINT AS dl FROM (SELECT doc, unnest(ws) AS term, len(ws) AS dl FROM (SELECT item_id AS doc, {WORDS.format('text')} AS ws FROM benchmark) a) b GROUP BY doc, term")
def tk_2_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-2."""
    return search.postings(frame(spark, sf_dir, "SELECT item_id, text FROM benchmark"), "item_id", F.col("text")).select("doc", "term", "tf", "dl")


ASKED = "SELECT 'q' || CAST(x.n AS STRING) AS query, x.term AS term FROM (SELECT 1 AS n, 'the' AS term UNION ALL SELECT 1, 'est' UNION ALL SELECT 2, 'oner' UNION ALL SELECT 2, 'de' UNION ALL SELECT 3, 'license') x"


@query(
    f"""WITH a AS ({ASKED}), d AS (SELECT doc_id AS doc, {WORDS.format("text")} AS ws FROM documents), s AS (SELECT count(*) AS n, avg(len(ws)) AS avg_dl FROM d),
    p AS (SELECT doc, term, dl, count(*) AS tf FROM (SELECT doc, len(ws) AS dl, unnest(ws) AS term FROM d) x WHERE term IN (SELECT term FROM a) GROUP BY ALL),
    i AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, s GROUP BY term, n)
    SELECT a.query, p.doc, round(sum(i.idf * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / s.avg_dl))), 6) AS score FROM p JOIN i ON i.term = p.term JOIN a ON a.term = p.term, s GROUP BY a.query, p.doc"""
)
def tk_3_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-3: scores of every document for each query."""
    return search.bm25(frame(spark, sf_dir, "SELECT doc_id, text FROM documents"), "doc_id", F.col("text"), frame(spark, sf_dir, ASKED)).withColumn("score", F.round("score", 6))


@query(f"SELECT doc_id AS doc FROM documents WHERE contains(' ' || array_to_string({WORDS.format('text')}, ' ') || ' ', ' of the ')")
def tk_3_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-3: phrase."""
    return search.phrase_hits(frame(spark, sf_dir, "SELECT doc_id, text FROM documents"), "doc_id", F.col("text"), "of the")


@query(f"SELECT doc_id AS doc, len(list_filter({WORDS.format('text')}, lambda w: starts_with(w, 'eren')))::BIGINT AS n_words FROM documents WHERE n_words > 0")
def tk_3_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-3: prefix."""
    return search.prefix_counts(frame(spark, sf_dir, "SELECT doc_id, text FROM documents"), "doc_id", F.col("text"), "eren")


@query(f"WITH {FIELDS} SELECT DISTINCT f.property_id, b.eid FROM f JOIN b_body b ON b.eid = f.eid WHERE f.name IN ('s1', 's7') AND NOT f.read_only")
def tk_4_keyword_to_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-4, request bodies only (all in ``tk_4_keyword_to_any_endpoint``): property hits, walked back from component to root to endpoint: only what a hit reaches moves."""
    hits = frame(spark, sf_dir, "b_property").where("name IN ('s1', 's7') AND NOT read_only").select(F.col("id").alias("property_id"), F.col("component_id").alias("root"))
    back = frame(spark, sf_dir, "b_composed").select(F.col("b").alias("a"), F.col("a").alias("b"))
    up = within(hits.select("root").distinct(), back, discover.HOPS).withColumnRenamed("node", "root_id")
    return hits.join(up, "root").join(frame(spark, sf_dir, "b_body").select("eid", "root_id"), "root_id").select("property_id", "eid").distinct()


SOUGHT = "SELECT 'q' AS query, 's1' AS term UNION ALL SELECT 'q', 's7'"


@query(
    f"""WITH r AS (SELECT eid, root_id FROM b_body UNION SELECT eid, root_id FROM b_response), {_walk(5, roots="r")},
    h AS (SELECT id AS property_id, component_id FROM b_property WHERE list_has_any({WORDS.format("name")}, ['s1', 's7']))
    SELECT DISTINCT h.property_id, x.eid FROM h LEFT JOIN (SELECT w.node, r.eid FROM w JOIN r ON r.root_id = w.root) x ON x.node = h.component_id"""
)
def tk_4_keyword_to_any_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-4: searched properties to all endpoints that accept or return them; a property that no endpoint has keeps a row without one."""
    properties = frame(spark, sf_dir, "b_property")
    found = search.query_postings(properties, "id", F.col("name"), frame(spark, sf_dir, SOUGHT)).select(F.col("doc").alias("id")).distinct()
    hits = properties.join(found, "id", "left_semi").select(F.col("id").alias("property_id"), F.col("component_id").alias("root"))
    back = frame(spark, sf_dir, "b_composed").select(F.col("b").alias("a"), F.col("a").alias("b"))
    up = within(hits.select("root").distinct(), back, discover.HOPS).withColumnRenamed("node", "root_id")
    ends = frame(spark, sf_dir, "b_body").select("eid", "root_id").unionByName(frame(spark, sf_dir, "b_response").select("eid", "root_id")).distinct()
    return hits.join(up.join(ends, "root_id").select("root", "eid").distinct(), "root", "left").select("property_id", "eid").distinct()


@query(f"WITH {YANG} SELECT DISTINCT p.id AS property_id, p.yang_path, regexp_extract(p.yang_path, '(?:^|/)([^/:]*):', 1) AS module, yang.eid, coalesce(c.command, '') AS command FROM b_property p JOIN yang ON yang.yang_path = p.yang_path LEFT JOIN b_cli c ON c.eid = yang.eid WHERE p.name = 's5'")
def tk_5_keyword_to_yang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-5: property hit to yang path, module, endpoint and command."""
    hits = frame(spark, sf_dir, "b_property").where("name = 's5' AND yang_path <> ''").select(F.col("id").alias("property_id"), "yang_path", discover.yang_module(F.col("yang_path")).alias("module"))
    cli = frame(spark, sf_dir, "b_cli").select("eid", "command")
    return hits.join(_yang(spark, sf_dir), "yang_path").join(cli, "eid", "left").select("property_id", "yang_path", "module", "eid", F.coalesce("command", F.lit("")).alias("command")).distinct()


@query("SELECT eid, path FROM b_endpoint WHERE contains(lower(path), 'brand-2') OR contains(lower(summary), 'brand-2')")
def tk_6_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-6."""
    return frame(spark, sf_dir, "b_endpoint").where(F.contains(F.lower("path"), F.lit("brand-2")) | F.contains(F.lower("summary"), F.lit("brand-2"))).select("eid", "path")


@query("SELECT doc_id, n_chars, (SELECT count(*) FROM documents) AS total FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200")
def tk_8_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-8: row caps with the total; the cap is the feature."""
    return discover.capped(frame(spark, sf_dir, "SELECT doc_id, n_chars FROM documents"), [F.desc("n_chars"), F.col("doc_id")])


FIELDED = f"d AS (SELECT doc_id AS doc, {WORDS.format('text')} AS f0, {WORDS.format('source')} AS f1 FROM documents), s AS (SELECT count(*) AS n, avg(len(f0) + len(f1)) AS avg_dl FROM d), o AS (SELECT doc, len(f0) + len(f1) AS dl, unnest(list_concat(f0, f1)) AS term FROM d), p AS (SELECT doc, dl, term, count(*) AS tf FROM o GROUP BY ALL)"
_SCORE = "round(sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / s.avg_dl))), 6) AS score"
ANY, PREFIXES, PHRASES = ("SELECT 1 AS query, 'The of WEB the' AS text UNION ALL SELECT 2, 'license est'", "SELECT 1 AS query, 'eren' AS text UNION ALL SELECT 2, 'th' UNION ALL SELECT 3, 'We'", "SELECT 1 AS query, 'of the' AS text UNION ALL SELECT 2, 'la de la' UNION ALL SELECT 3, 'no such words here'")


def _index(spark: SparkSession, sf_dir: str) -> search.Index:
    """An index of texts and sources of documents, written to the shared folder and read back."""
    return search.write_index(frame(spark, sf_dir, "SELECT doc_id, text, source FROM documents"), "doc_id", {"text": F.col("text"), "source": F.col("source")}, scratch_folder(spark, "index"))


@query(f"WITH {FIELDED}, q AS (SELECT DISTINCT query, unnest({WORDS.format('text')}) AS term FROM ({ANY}) x), i AS (SELECT term, count(*) AS df FROM p GROUP BY term) SELECT query, doc, {_SCORE} FROM q JOIN p USING (term) JOIN i USING (term), s GROUP BY query, doc")
def tk_2_index_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-2, TK-3: scores of any of a query's words, from a written index of two fields."""
    return _index(spark, sf_dir).any_word(frame(spark, sf_dir, ANY)).withColumn("score", F.round("score", 6))


@query(f"WITH {FIELDED}, q AS ({PREFIXES}), i AS (SELECT term, count(*) AS df FROM p GROUP BY term) SELECT query, doc, {_SCORE} FROM q JOIN p ON starts_with(p.term, lower(q.text)) JOIN i ON i.term = p.term, s GROUP BY query, doc")
def tk_3_index_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-3: scores of words that begin with what is asked for, from the index's dictionary."""
    return _index(spark, sf_dir).prefix(frame(spark, sf_dir, PREFIXES)).withColumn("score", F.round("score", 6))


@query(
    f"""WITH {FIELDED}, q AS (SELECT query, {WORDS.format("text")} AS ws FROM ({PHRASES}) x), h AS (SELECT query, doc, dl, count(*) AS tf FROM (SELECT q.query, d.doc, len(f0) + len(f1) AS dl, q.ws, f.ws AS words, unnest(range(1, len(f.ws) + 1)) AS i FROM q CROSS JOIN d CROSS JOIN LATERAL (SELECT unnest([d.f0, d.f1]) AS ws) f) x WHERE words[i : i + len(ws) - 1] = ws GROUP BY ALL),
    i AS (SELECT query, count(*) AS df FROM h GROUP BY query) SELECT query, doc, {_SCORE} FROM h JOIN i USING (query), s GROUP BY query, doc"""
)
def tk_3_index_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-3: scores of phrases, by the places of their words in one field."""
    return _index(spark, sf_dir).phrase(frame(spark, sf_dir, PHRASES)).withColumn("score", F.round("score", 6))
