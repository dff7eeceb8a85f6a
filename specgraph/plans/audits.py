"""Queries of merges, audits, metrics and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgraph.operators import audit, merge
from specgraph.operators.walk import scratch_folder
from specgraph.plans.bridge import VIEWS, frame, keep
from specgraph.plans.registry import query

BEST = "best AS (SELECT provider, section, name, body, ord FROM (SELECT *, row_number() OVER (PARTITION BY provider, section, name ORDER BY length(body) DESC, ord) AS k FROM b_source_row) x WHERE k = 1)"
KEYS = ["provider", "section", "name"]


@query(f"WITH {BEST} SELECT * FROM best")
def ag_2_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-2: longest body of each name, first of equals; of several rows at one place the first of the table's files."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines.select("*", F.col("_metadata.file_path").alias("at_file"), F.col("_metadata.row_index").alias("at_row")).createOrReplaceTempView("placed_lineitem")
    rows = spark.sql(VIEWS["b_source_row"].replace(" FROM lineitem", ", at_file, at_row FROM placed_lineitem"))
    return merge.longest_wins(rows, KEYS, ties=("at_file", "at_row")).select(*KEYS, "body", "ord")


@query(f"WITH {BEST} SELECT r.provider, r.name, count(*) AS n_rows FROM b_source_row r JOIN best b ON b.provider = r.provider AND b.section = r.section AND b.name = r.name AND b.ord = r.ord GROUP BY ALL")
def ag_3_rows_of_winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-3: dependent rows only of the winning definition."""
    rows = frame(spark, sf_dir, "b_source_row")
    return merge.rows_of_winners(merge.longest_wins(rows, KEYS), rows, KEYS, "ord").groupBy("provider", "name").agg(F.count("*").alias("n_rows"))


EXISTING = "SELECT provider, section, name, body FROM (SELECT *, row_number() OVER (PARTITION BY provider, section, name ORDER BY ord) AS k FROM b_source_row) x WHERE k = 1"


@query(f"WITH {BEST}, old AS ({EXISTING}) SELECT b.provider, b.section, b.name, CASE WHEN length(b.body) > length(old.body) THEN b.body ELSE old.body END AS body, length(b.body) > length(old.body) AS is_new FROM best b JOIN old ON old.provider = b.provider AND old.section = b.section AND old.name = b.name")
def ag_4_merge_with_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-4, ST-4: a second run over existing rows."""
    rows = frame(spark, sf_dir, "b_source_row")
    return merge.merge_with_existing(frame(spark, sf_dir, EXISTING), merge.longest_wins(rows, KEYS), KEYS)


@query(
    """SELECT provider, section, name, hash, CASE WHEN k = 1 THEN base ELSE base || '@' || substr(hash, 1, 12) END AS id, k = 1 AS is_primary FROM (SELECT *, provider || ':' || section || ':' || name AS base,
    row_number() OVER (PARTITION BY provider, section, name ORDER BY size DESC, hash DESC) AS k FROM (SELECT DISTINCT provider, section, name, sha1(body) AS hash, length(body) AS size FROM b_source_row) x) y"""
)
def ag_5_catalogue_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-5."""
    return merge.catalogue_ids(frame(spark, sf_dir, "b_source_row"))


@query("SELECT count(*) AS n_base, sum(b - 1)::BIGINT AS n_variant, count_if(b > 1) AS n_conflict, sum(r - b)::BIGINT AS n_merged FROM (SELECT count(DISTINCT sha1(body)) AS b, count(*) AS r FROM b_source_row GROUP BY provider, section, name) x")
def ag_6_identity_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-6."""
    return merge.identity_statistics(frame(spark, sf_dir, "b_source_row"))


ENTITY = "SELECT name AS label, yang_path, id AS pointer, required, component_id AS owner FROM b_property"


@query(
    f"""SELECT identity, arg_min(label, pointer) AS label, string_agg(DISTINCT pointer, ',' ORDER BY pointer) AS pointers, bool_or(required) AS required, count(*) AS n FROM (SELECT *, CASE WHEN yang_path <> '' THEN 'yang:' || yang_path
    ELSE 'property:' || lower(label) END AS identity FROM ({ENTITY}) e) x GROUP BY identity"""
)
def ag_8_model_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-8, SM-6: rows of one identity merged."""
    rows = frame(spark, sf_dir, ENTITY).withColumn("identity", merge.identity_key(F.col("yang_path"), F.col("label"), F.col("pointer"), "property")).withColumn("ord", F.col("pointer"))
    return merge.merge_entities(rows)


@query("SELECT DISTINCT 'MODEL_COMPOSED_OF' AS kind, a.kind AS a, b.kind AS b FROM b_composed e JOIN b_component a ON a.id = e.a JOIN b_component b ON b.id = e.b UNION SELECT DISTINCT 'MODEL_HAS_VALUE', a.kind, b.kind FROM b_value e JOIN b_component a ON a.id = e.a JOIN b_component b ON b.id = e.b")
def jn_11_model_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-11: edges between nodes as edges between models (here: their kind)."""
    edges = frame(spark, sf_dir, "SELECT 'MODEL_COMPOSED_OF' AS kind, a, b FROM b_composed UNION ALL SELECT 'MODEL_HAS_VALUE', a, b FROM b_value")
    return merge.rewrite_edges(edges, frame(spark, sf_dir, "b_component").select(F.col("id").alias("node"), F.col("kind").alias("model")))


@query(
    """SELECT p.id AS property_id, coalesce(c.id, '') AS component_id, coalesce(c.kind, '') AS kind, CASE WHEN c.id IS NULL THEN 'none' WHEN c.kind = 'unresolved' THEN 'loose' ELSE 'strict' END AS quality
    FROM b_property p LEFT JOIN b_component c ON c.id = p.type_id"""
)
def jn_12_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN-12: where a row's type comes from, with the quality of the answer."""
    c = frame(spark, sf_dir, "b_component").select(F.col("id").alias("type_id"), F.col("id").alias("component_id"), "kind")
    quality = F.when(F.col("component_id").isNull(), "none").when(F.col("kind") == "unresolved", "loose").otherwise("strict")
    return frame(spark, sf_dir, "b_property").drop("component_id").join(c, "type_id", "left").select(F.col("id").alias("property_id"), F.coalesce("component_id", F.lit("")).alias("component_id"), F.coalesce("kind", F.lit("")).alias("kind"), quality.alias("quality"))


def _first(sql: str) -> str:
    return f"coalesce((SELECT string_agg(detail, ',' ORDER BY detail) FROM (SELECT detail FROM ({sql}) s ORDER BY detail LIMIT 25) t), '')"


#: A typed graph with offenders of every invariant: kinds and shapes that disagree, repeated ids and names, edges left out, led astray or doubled.
GRAPH = {
    "component": """SELECT id, CASE WHEN ord % 37 = 5 THEN 'primitive' ELSE kind END AS kind, CASE WHEN ord % 41 = 7 THEN '' WHEN ord % 3 <> 0 THEN '{"type":"object","properties":{}}' ELSE body_json END AS body,
        CASE WHEN ord % 43 = 3 THEN 'primitive' WHEN kind = 'union' THEN 'union-oneOf' WHEN kind = 'map' THEN 'map' ELSE 'object' END AS shape, ord % 11 <> 0 AS named
        FROM (SELECT * FROM b_component UNION ALL SELECT * FROM b_component WHERE ord % 53 = 1) x""",
    "property": "SELECT id, CASE WHEN name LIKE '%8' THEN '' ELSE component_id END AS parent, name FROM b_property UNION ALL SELECT id || '~2', component_id, name FROM b_property WHERE name LIKE '%3'",
    "has_property": """SELECT CASE WHEN name LIKE '%6' THEN component_id || '~' ELSE component_id END AS a, id AS b FROM b_property WHERE name NOT LIKE '%7' AND length(component_id) % 3 <> 0
        UNION ALL SELECT component_id, id || '~2' FROM b_property WHERE name LIKE '%3'""",
    "composed": "SELECT a, b FROM b_composed WHERE length(a) % 2 = 1", "value": "SELECT a, b FROM b_value WHERE length(a) % 2 = 1", "command": "SELECT id FROM b_cli",
    "has_command": "SELECT eid AS a, id AS b FROM b_cli WHERE length(id) % 5 <> 0 UNION ALL SELECT eid || '~', id FROM b_cli WHERE length(id) % 7 = 0",
    "yang": "SELECT DISTINCT yang_path AS path, CASE WHEN contains(yang_path, ':') THEN substr(yang_path, 2, 4) ELSE '' END AS module FROM b_property WHERE yang_path <> ''",
    "in_module": "SELECT DISTINCT yang_path AS a, substr(yang_path, 2, 4) AS b FROM b_property WHERE yang_path <> '' AND yang_path NOT LIKE '%15'",
}
SHAPE_LIST = "('object', 'union-oneOf', 'union-anyOf', 'allOf-composite', 'map')"
NO_EDGE = "NOT EXISTS (SELECT 1 FROM {} e WHERE e.a = c.id)"
FROM_COMPONENT = "SELECT a, b FROM g_has_property WHERE a IN (SELECT id FROM g_component)"
OFFENDERS = {
    "INV-1": f"""SELECT c.id AS detail FROM g_component c WHERE body <> '' AND kind NOT IN ('primitive', 'unresolved') AND shape IN {SHAPE_LIST} AND NOT (shape = 'object' AND NOT contains(body, '"properties"')) AND named
        AND {NO_EDGE.format("g_has_property")} AND {NO_EDGE.format("g_composed")} AND {NO_EDGE.format("g_value")}""",
    "INV-2": f"SELECT id AS detail FROM g_component WHERE kind = 'primitive' AND body <> '' AND shape IN {SHAPE_LIST}",
    "INV-3": "SELECT id AS detail FROM g_component GROUP BY id HAVING count(*) > 1",
    "INV-5": "SELECT e.a || '|' || p.name AS detail FROM (SELECT DISTINCT a, b FROM g_has_property) e JOIN g_property p ON p.id = e.b GROUP BY e.a, p.name HAVING count(*) > 1",
    "INV-6": f"""SELECT c.id AS detail FROM g_component c WHERE shape = 'object' AND body <> '' AND contains(body, '"properties"') AND kind <> 'unresolved' AND named AND {NO_EDGE.format("g_has_property")}""",
    "INV-7": f"SELECT id AS detail FROM g_component WHERE body <> '' AND ((shape IN {SHAPE_LIST} AND kind = 'primitive') OR (shape = 'primitive' AND kind = 'object'))",
    "INV-8": f"SELECT id AS detail FROM g_property WHERE id NOT IN (SELECT b FROM ({FROM_COMPONENT}) f)",
    "INV-9": f"SELECT p.id AS detail FROM g_property p WHERE parent <> '' AND NOT EXISTS (SELECT 1 FROM ({FROM_COMPONENT}) f WHERE f.a = p.parent AND f.b = p.id)",
    "INV-13": "SELECT c.id AS detail FROM (SELECT DISTINCT id FROM g_command) c LEFT JOIN g_has_command e ON e.b = c.id GROUP BY c.id HAVING count(e.b) <> 1",
    "INV-14": "SELECT y.path || '|' || y.module AS detail FROM (SELECT DISTINCT * FROM g_yang WHERE module <> '') y LEFT JOIN g_in_module m ON m.a = y.path AND m.b = y.module GROUP BY y.path, y.module HAVING count(m.b) <> 1",
}
WITH_GRAPH = "WITH " + ", ".join(f"g_{n} AS ({s})" for n, s in GRAPH.items())
ALL_OFFENDERS = " UNION ALL ".join(f"SELECT '{n}' AS invariant, (SELECT count(*) FROM ({s}) c) AS n, {_first(s)} AS sample" for n, s in OFFENDERS.items())


@query(f"{WITH_GRAPH} {ALL_OFFENDERS}")
def ag_9_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-9: offenders of each invariant with a sample, on a graph that has some of each."""
    kept = keep(spark, sf_dir, "b_component", "b_property")
    return audit.graph_invariants({n: frame(spark, sf_dir, s, kept) for n, s in GRAPH.items()})


LEFT = """SELECT 'component' AS check, id AS key FROM b_component UNION ALL SELECT 'property', id FROM b_property UNION ALL SELECT 'composed', a || '|' || b FROM b_composed UNION ALL SELECT 'body', eid || '|' || root_id FROM b_body"""
RIGHT = """SELECT 'component' AS check, CASE WHEN ord % 5 = 0 THEN id || '@0123456789ab' ELSE id END AS key FROM b_component WHERE ord % 7 <> 0 UNION ALL SELECT 'property', id FROM b_property WHERE NOT read_only
 UNION ALL SELECT 'composed', a || '|' || b || CASE WHEN length(a) % 2 = 0 THEN 'x' ELSE '' END FROM b_composed UNION ALL SELECT 'body', eid || '|' || root_id FROM b_body WHERE method_free(eid)""".replace("WHERE method_free(eid)", "WHERE eid LIKE 'P%'")


@query(
    f"""WITH k AS (SELECT "check", key, max(l) AS l, max(r) AS r FROM (SELECT *, 1 AS l, 0 AS r FROM ({LEFT}) a UNION ALL SELECT *, 0, 1 FROM ({RIGHT}) b) x GROUP BY "check", key)
    SELECT "check", sum(l)::BIGINT AS n_left, sum(r)::BIGINT AS n_right, sum(l * (1 - r))::BIGINT AS missing, sum(r * (1 - l))::BIGINT AS extra, CASE WHEN sum(l) = 0 THEN 1.0 ELSE round(sum(l * r) / sum(l), 4) END AS coverage FROM k GROUP BY "check\"""".replace("AS check", 'AS "check"')
)
def ag_11_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-11, ST-2: two builds of the same tables."""
    return audit.parity(frame(spark, sf_dir, LEFT), frame(spark, sf_dir, RIGHT))


@query(
    f"""WITH l AS (SELECT DISTINCT * FROM ({LEFT}) a), r AS (SELECT DISTINCT * FROM ({RIGHT}) b), m AS (SELECT * FROM l EXCEPT SELECT * FROM r),
    nl AS (SELECT "check", split_part(key, '|', 1) AS c FROM l WHERE contains(key, '|') GROUP BY ALL HAVING count(*) = 1), nr AS (SELECT "check", split_part(key, '|', 1) AS c FROM r WHERE contains(key, '|') GROUP BY ALL HAVING count(*) = 1),
    x AS (SELECT m."check", EXISTS (SELECT 1 FROM r WHERE r."check" = m."check" AND regexp_replace(r.key, '@[0-9a-f]{{12}}', '', 'g') = regexp_replace(m.key, '@[0-9a-f]{{12}}', '', 'g')) AS alias,
    EXISTS (SELECT 1 FROM nl JOIN nr ON nl."check" = nr."check" AND nl.c = nr.c WHERE nl."check" = m."check" AND nl.c = split_part(m.key, '|', 1)) AS target FROM m)
    SELECT "check", count(*) AS n_missing, count_if(alias) AS n_alias, count_if(NOT alias AND target) AS n_target, count_if(NOT alias AND NOT target) AS n_open FROM x GROUP BY "check\"""".replace("AS check", 'AS "check"')
)
def ag_12_excuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-12 without the structural excuse: missing keys with an excuse."""
    return audit.excused(frame(spark, sf_dir, LEFT), frame(spark, sf_dir, RIGHT))


@query(
    """SELECT count(*) AS total, round(count_if(eid IN (SELECT eid FROM b_body)) / count(*), 4) AS has_body, round(count_if(eid IN (SELECT eid FROM b_response)) / count(*), 4) AS has_response,
    round(count_if(eid IN (SELECT eid FROM b_parameter WHERE required)) / count(*), 4) AS has_required, round(count_if(eid IN (SELECT eid FROM b_cli)) / count(*), 4) AS has_cli FROM (SELECT DISTINCT eid FROM b_endpoint) e"""
)
def ag_15_endpoint_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of AG-13 and AG-15 (README), ST-3: shares of endpoints that have bodies, responses, required parameters, commands."""
    keys = {n: frame(spark, sf_dir, t).select(F.col("eid").alias("key")) for n, t in (("body", "b_body"), ("response", "b_response"), ("required", "SELECT eid FROM b_parameter WHERE required"), ("cli", "b_cli"))}
    return audit.coverage(frame(spark, sf_dir, "b_endpoint"), "eid", keys)


PARTIAL = "SELECT 'required' AS metric, category AS report, count_if(required) AS part, count(*) AS whole FROM (SELECT p.required, substr(p.component_id, 1, 5) AS category FROM b_property p) x GROUP BY category UNION ALL SELECT 'deprecated', category, count_if(deprecated), count(*) FROM b_endpoint GROUP BY category"


@query(f"SELECT metric, sum(part)::BIGINT AS part, sum(whole)::BIGINT AS whole, round(sum(part) / sum(whole), 4) AS ratio FROM ({PARTIAL}) p GROUP BY metric")
def ag_14_merged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-14."""
    return audit.merged_metrics(frame(spark, sf_dir, PARTIAL))


@query("SELECT kind, count(*) AS n, count_if(p.n IS NULL) AS n_empty, round(coalesce(avg(p.n), 0), 4) AS mean_properties FROM b_component c LEFT JOIN (SELECT component_id, count(*) AS n FROM b_property GROUP BY 1) p ON p.component_id = c.id GROUP BY kind")
def ag_16_build_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-16: components by kind, empty ones, mean number of properties."""
    own = frame(spark, sf_dir, "b_property").groupBy(F.col("component_id").alias("id")).agg(F.count("*").alias("p"))
    joined = frame(spark, sf_dir, "b_component").join(own, "id", "left")
    return joined.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(F.col("p").isNull()).alias("n_empty"), F.round(F.coalesce(F.avg("p"), F.lit(0.0)), 4).alias("mean_properties"))


FETCH = "SELECT source, doc_id % 9 <> 4 AND n_chars > 60 AS fetched, CASE WHEN n_chars <= 60 THEN 'short' WHEN doc_id % 9 = 4 THEN 'timeout' ELSE '' END AS failure FROM documents"


@query(
    f"""WITH f AS ({FETCH}), g AS (SELECT source, string_agg(failure || '=' || CAST(n AS STRING), ',' ORDER BY failure || '=' || CAST(n AS STRING)) AS failures FROM (SELECT source, failure, count(*) AS n FROM f WHERE failure <> '' GROUP BY ALL) x GROUP BY source)
    SELECT f.source, count(*) AS discovered, count_if(fetched) AS fetched, count_if(NOT fetched) AS missing, round(count_if(fetched) / count(*), 4) AS coverage,
    CASE WHEN count_if(fetched) = 0 THEN 'error' WHEN round(count_if(fetched) / count(*), 4) < 0.95 THEN 'degraded' ELSE 'ok' END AS status, coalesce(max(g.failures), '') AS failures FROM f LEFT JOIN g ON g.source = f.source GROUP BY f.source"""
)
def ag_17_sync_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-17, AG-20."""
    return audit.sync_health(frame(spark, sf_dir, FETCH))


GATES = f"""{WITH_GRAPH}, i AS (SELECT sum(n) = 0 AS ok FROM ({ALL_OFFENDERS}) x), p AS (SELECT sum(CASE WHEN r.key IS NULL THEN 1 ELSE 0 END) = 0 AS ok FROM ({LEFT}) l LEFT JOIN ({RIGHT}) r ON r."check" = l."check" AND r.key = l.key),
    t AS (SELECT count(*) = 0 AS ok FROM b_body WHERE root_id NOT IN (SELECT id FROM b_component))
    SELECT i.ok AND t.ok AS passed, p.ok AS parity_passed, i.ok AS invariants_passed, t.ok AS traversal_passed, p.ok AND i.ok AND t.ok AS default_flip_ready FROM i, p, t""".replace("AS check", 'AS "check"')


@query(GATES)
def ag_18_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-10, AG-18: release and switch-over gates from invariants, parity and dangling bodies."""
    invariants = ag_9_invariants(spark, sf_dir).agg((F.sum("n") == 0).alias("invariants_passed"))
    parity = ag_11_parity(spark, sf_dir).agg((F.sum("missing") == 0).alias("parity_passed"))
    body = audit.dangling(frame(spark, sf_dir, "b_body"), "root_id", frame(spark, sf_dir, "b_component"), "id").agg((F.count("*") == 0).alias("traversal_passed"))
    one = invariants.crossJoin(parity).crossJoin(body)  # one row each
    passed = F.col("invariants_passed") & F.col("traversal_passed")
    return one.select(passed.alias("passed"), "parity_passed", "invariants_passed", "traversal_passed", (passed & F.col("parity_passed")).alias("default_flip_ready"))


@query(
    """WITH h AS (SELECT sha256(text) AS h, count(*) AS n FROM documents GROUP BY 1), d AS (SELECT ('0x' || substr(h, 1, 3))::INT AS bucket, sha256(string_agg(h || '*' || CAST(n AS STRING), '' ORDER BY h || '*' || CAST(n AS STRING))) AS d FROM h GROUP BY 1)
    SELECT sha256(string_agg(d, '' ORDER BY bucket)) AS fingerprint FROM d"""
)
def ag_19_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-19: an order-free digest of a corpus."""
    return audit.corpus_fingerprint(frame(spark, sf_dir, "SELECT text FROM documents"), F.col("text"))


def _rank(p: int) -> str:
    return f"list_sort(list(n_chars))[CAST(round({p / 100} * (count(*) - 1)) AS BIGINT) + 1] AS p{p}"


@query(f"SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS total_size, min(n_chars) AS least, {', '.join(_rank(p) for p in (50, 90, 95, 99))}, max(n_chars) AS most, round(avg(n_chars), 4) AS mean FROM documents GROUP BY source")
def ag_21_size_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-21: exact nearest-rank percentiles."""
    return audit.size_profile(frame(spark, sf_dir, "SELECT source, n_chars FROM documents"), "n_chars", "source")


@query("SELECT category, path, string_agg(DISTINCT method, '|' ORDER BY method) AS methods, bool_or(deprecated) AS deprecated FROM b_endpoint GROUP BY category, path")
def ag_22_path_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-22."""
    return audit.path_tree(frame(spark, sf_dir, "b_endpoint"))


@query("SELECT top::INT AS top, round(upto / (SELECT sum(n_chars) FROM documents), 4) AS share FROM (SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) AS top, sum(n_chars) OVER (ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM documents) x WHERE top IN (1, 5, 10, 25, 50, 100, 250, 500, 1000)")
def wn_1_top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-1."""
    return audit.top_share(frame(spark, sf_dir, "SELECT doc_id, n_chars FROM documents"), "n_chars", "doc_id")


@query("SELECT source, count_if(upto <= 50000) AS kept, count_if(upto > 50000) AS dropped FROM (SELECT source, sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM documents) x GROUP BY source")
def wn_2_byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN-2."""
    return audit.byte_budget(frame(spark, sf_dir, "SELECT source, doc_id, text FROM documents"), "source", "doc_id", F.col("text"))


@query("SELECT page_id, length(html)::BIGINT AS size FROM pages ORDER BY size DESC, page_id LIMIT 20")
def tk_7_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK-7: the limit is the feature."""
    return frame(spark, sf_dir, "SELECT page_id, CAST(length(html) AS BIGINT) AS size FROM pages").orderBy(F.desc("size"), "page_id").limit(20)


#: Two batches of components with rows of their sub-graphs, as many as their body's length says; the second has longer bodies for some.
_BATCH = "SELECT id, body, ord FROM (SELECT provider || ':schemas:' || name AS id, body, ord, row_number() OVER (PARTITION BY provider, name ORDER BY length(body) DESC, ord, body) AS k FROM (SELECT provider, name, ord, body || repeat('x', CAST(ord % 5 AS INT)) AS body FROM b_source_row WHERE ord % 2 = {half}) w) x WHERE k = 1"
_ROWS_OF = "SELECT id || '#prop:' || CAST(i AS STRING) AS row_id, id AS a, ord FROM (SELECT id, ord, {series} AS i FROM ({batch}) y WHERE length(body) % 4 > 0) z"


@query(
    f"""WITH b0 AS ({_BATCH.format(half=0)}), b1 AS ({_BATCH.format(half=1)}), won AS (SELECT coalesce(b0.id, b1.id) AS id, CASE WHEN b0.id IS NULL OR length(b1.body) > length(b0.body) THEN b1.body ELSE b0.body END AS body, CASE WHEN b0.id IS NULL OR length(b1.body) > length(b0.body) THEN b1.ord ELSE b0.ord END AS ord FROM b0 FULL JOIN b1 ON b1.id = b0.id)
    SELECT 'component' AS table_name, id AS row_id, body AS value FROM won UNION ALL SELECT 'property', row_id, CAST(ord AS VARCHAR) FROM ({_ROWS_OF.format(series="unnest(range(0, length(body) % 4))", batch="SELECT * FROM won")}) p UNION ALL SELECT 'runs', 'third', '0'"""
)
def ag_4_incremental_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-4: a stored graph after two runs: richer components have replaced others with their sub-graphs; a third run rewrites nothing."""
    path, rewritten = scratch_folder(spark, "graph"), 0
    for half in (0, 1, 1):
        batch = _BATCH.format(half=half)
        rows = frame(spark, sf_dir, _ROWS_OF.format(series="explode(sequence(0, CAST(length(body) % 4 AS INT) - 1))", batch=batch)).select("row_id", "ord")
        rewritten = merge.merge_graph(path, frame(spark, sf_dir, batch).select("id", "body"), {"property": (rows, "row_id")})
    stored = spark.read.parquet(f"{path}/component").select(F.lit("component").alias("table_name"), F.col("id").alias("row_id"), F.col("body").alias("value"))
    stored = stored.unionByName(spark.read.parquet(f"{path}/property").select(F.lit("property").alias("table_name"), "row_id", F.col("ord").cast("string").alias("value")))
    return stored.unionByName(spark.range(1).select(F.lit("runs").alias("table_name"), F.lit("third").alias("row_id"), F.lit(str(rewritten)).alias("value")))
