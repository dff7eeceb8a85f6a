"""Queries of whole rows, on documents that are written for them from parts, one document a row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specgraph.operators import details, merge, specs
from specgraph.operators.walk import shared_checkpoint
from specgraph.plans.bridge import dealt, frame
from specgraph.plans.lineage import ROWS, _corpus, _documents, _hashed
from specgraph.plans.registry import query

#: Properties in place, behind references of the document, of the provider and to nothing, nested, with odd values; C differs between documents; a shape in an operation.
_FIELDS = """'{"paths":{"/p/' || t || '":{"get":{"responses":{"200":{"content":{"application/json":{"schema":{"type":"object","properties":{"q":{"type":["string","null"]}}}}}}}}}},"components":{"schemas":{"A' || t || '":{"type":"object","required":["s","n","s","gone",5],"properties":{'
    || '"s":{"type":"string","format":"date","pattern":"^a","minLength":2,"maxLength":9,"enum":["x",1,2.5,true,null,[]],"default":{"z":1,"a":2},"description":"d' || t || '","x-path":"/m' || CAST(k % 4 AS STRING) || ':top/s","x-key":["k"],"x-supportedDeviceType":["AP",1,"SWITCH"]},'
    || '"n":{"type":"integer","minimum":1.5,"maximum":true,"minLength":"3","readOnly":true,"default":null,"x-enumDescriptions":{"1":"one"}},"r":{"$ref":"#/components/schemas/E","description":"own","x-a":1,"x-path":5},"p":{"$ref":"#/components/schemas/Pool"},"g":{"$ref":"#/components/schemas/Gone","x-b":true},"b":7,'
    || '"o":{"type":"object","required":["i"],"properties":{"i":{"type":"boolean","readOnly":"yes"},"properties":{}}}}},"E":{"type":"string","format":"uuid","enum":["e"],"description":"e","readOnly":true,"x-a":2,"x-supportedDeviceType":"GW","x-c":{"b":1,"a":[1]}},'
    || '"C":{"properties":{"c":{"description":"' || repeat('w', CAST(k % 4 AS INT)) || '"}' || CASE WHEN k % 4 = 0 THEN ',"d":{}' ELSE '' END || '}}' || CASE WHEN k % 5 = 0 THEN ',"Pool":{"type":"number","description":"' || repeat('p', CAST(k % 3 AS INT)) || '"}' ELSE '' END || '}}}'"""
#: name, type, format, required, enum values, description, devices, extensions, read-only, pattern, default, minimum, maximum, shortest, longest, enum descriptions, constraints; ``~`` stands for no devices.
_KNOWN = """('s', 'string', 'date', true, 'x,1,2.5,True', '', 'AP,SWITCH', '', false, '^a', '{"a":2,"z":1}', NULL, NULL, 2, 9, '', '{"default":{"a":2,"z":1},"enum":["x",1,2.5,true,null,[]],"maxLength":9,"minLength":2,"pattern":"^a","x-key":["k"]}'),
    ('n', 'integer', '', true, '', '', '~', '{"x-enumDescriptions":{"1":"one"}}', true, '', 'null', 1.5, NULL, NULL, NULL, '{"1":"one"}', '{"default":null,"maximum":true,"minLength":"3","minimum":1.5,"readOnly":true,"x-enumDescriptions":{"1":"one"}}'),
    ('r', 'string', 'uuid', false, 'e', 'e', 'GW', '{"x-a":1,"x-c":{"a":[1],"b":1},"x-path":5,"x-supportedDeviceType":"GW"}', true, '', '', NULL, NULL, NULL, NULL, '', '{}'),
    ('p', 'number', '', false, '', '', '~', '', false, '', '', NULL, NULL, NULL, NULL, '', '{}'), ('g', '', '', false, '', '', '~', '{"x-b":true}', false, '', '', NULL, NULL, NULL, NULL, '', '{}'), ('b', '', '', false, '', '', '~', '', false, '', '', NULL, NULL, NULL, NULL, '', '{}'),
    ('o', 'object', '', false, '', '', '~', '', false, '', '', NULL, NULL, NULL, NULL, '', '{"required":["i"]}')"""
_COLUMNS = "name, type, format, required, enum_values, description, device_types, extensions, read_only, pattern, default_value, minimum, maximum, min_length, max_length, enum_descriptions, constraints"
_PLAIN = "'' AS format, false AS required, '' AS enum_values, '' AS description, NULL AS device_types, '' AS yang_path, '' AS extensions, false AS read_only, '' AS pattern, '' AS default_value, NULL::DOUBLE AS minimum, NULL::DOUBLE AS maximum, NULL::BIGINT AS min_length, NULL::BIGINT AS max_length, '' AS enum_descriptions"
_C = "SELECT provider, CASE WHEN max(k % 4 = 0) THEN '' ELSE repeat('w', max(k % 4)::INT) END AS c, max(k % 4 = 0) AS d FROM x GROUP BY provider"


@query(
    f"""WITH x AS (SELECT *, 'made' || (k % 2)::VARCHAR AS provider FROM ({ROWS}) y), pool AS (SELECT provider, max(repeat('p', (k % 3)::INT)) AS prose, true AS there FROM x WHERE k % 5 = 0 GROUP BY provider), c AS ({_C}),
    known({_COLUMNS}) AS (VALUES {_KNOWN}), r AS (
    SELECT x.provider || ':schemas:A' || t AS component_id, v.* REPLACE (CASE v.name WHEN 's' THEN 'd' || t WHEN 'p' THEN CASE WHEN k % 5 = 0 THEN repeat('p', (k % 3)::INT) ELSE coalesce(prose, '') END ELSE v.description END AS description, CASE WHEN v.name = 'p' AND k % 5 <> 0 AND there IS NULL THEN '' ELSE v.type END AS type,
    nullif(v.device_types, '~') AS device_types, CASE WHEN v.name = 's' THEN '{{"x-key":["k"],"x-path":"/m' || (k % 4)::VARCHAR || ':top/s","x-supportedDeviceType":["AP",1,"SWITCH"]}}' ELSE v.extensions END AS extensions), CASE WHEN v.name = 's' THEN '/m' || (k % 4)::VARCHAR || ':top/s' ELSE '' END AS yang_path FROM x LEFT JOIN pool ON pool.provider = x.provider CROSS JOIN known v
    UNION ALL BY NAME SELECT provider || ':schemas:A' || t || '#prop:o#object' AS component_id, v.name, v.type, {_PLAIN.replace("false AS required", "v.name = 'i' AS required")}, v.constraints FROM x CROSS JOIN (VALUES ('i', 'boolean', '{{"readOnly":"yes"}}'), ('properties', '', '{{}}')) v(name, type, constraints)
    UNION ALL BY NAME SELECT {_hashed('k', "'/paths/~1p~1' || t || '/get/responses/200/content/application~1json/schema'")} AS component_id, 'q' AS name, '["string","null"]' AS type, {_PLAIN}, '{{}}' AS constraints FROM x
    UNION ALL BY NAME SELECT provider || ':schemas:C' AS component_id, 'c' AS name, '' AS type, {_PLAIN.replace("'' AS description", "c AS description")}, '{{}}' AS constraints FROM c
    UNION ALL BY NAME SELECT provider || ':schemas:C' AS component_id, 'd' AS name, '' AS type, {_PLAIN}, '{{}}' AS constraints FROM c WHERE d)
    SELECT component_id || '#prop:' || name AS id, * FROM r"""
)
def sg_8_whole_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SG-7, SG-8, SM-2, SM-5: properties with formats, values, extensions of both sides, devices, model paths, and constraints as columns and as a bag."""
    corpus, ast = _corpus(spark, sf_dir, _FIELDS)
    rows = details.property_details(ast, specs.spec_rows(corpus)).drop("spec_id", "pointer")
    return rows.withColumn("enum_values", F.array_join("enum_values", ",")).withColumn("device_types", F.array_join("device_types", ","))


#: Operations with referenced and nested parts, a circle, a body in another media type, odd tags, no title; trace makes no row; every third path is in two documents.
_OPERATIONS = """'{' || CASE WHEN k % 4 = 0 THEN '' ELSE '"info":{"title":"T' || t || '"},' END || '"paths":{"/e/' || CAST(CASE WHEN k % 3 = 2 THEN k - 1 ELSE k END AS STRING) || '":{"parameters":[{"name":"above","in":"query"}],"trace":{"summary":"t"},"delete":{},"post":{"operationId":"op' || t || '","summary":"s","description":"long","tags":["a",1,"b"],"deprecated":true,'
    || '"parameters":[{"$ref":"#/components/parameters/P"},{"name":"n","in":"path","required":true},"odd",{"$ref":"#/components/parameters/Gone"}],"requestBody":{"$ref":"#/components/requestBodies/B"},"responses":{"200":{"$ref":"#/components/responses/R"},"404":{"description":"none","content":{"text/plain":{"schema":{}}}}}},'
    || '"get":{"tags":"a","requestBody":{"content":{}},"responses":{"default":{"content":{"application/json":{"schema":{"$ref":"#/components/schemas/S' || t || '"}}}}}}}},"components":{"parameters":{"P":{"name":"p","in":"query","description":"d","schema":{"$ref":"#/components/schemas/S' || t || '"}}},"requestBodies":{"B":{"content":{"text/xml":{"schema":{"type":"x"}},'
    || '"application/merge-patch+json":{"schema":{"allOf":[{"$ref":"#/components/schemas/S' || t || '"},{"$ref":"#/components/schemas/None"}]}}}}},"responses":{"R":{"description":"fine","content":{"application/json":{}}}},"schemas":{"S' || t || '":{"v":' || t || '}}}}'"""
_S = "'{\"v\":' || t || '}'"


@query(
    f"""WITH x AS (SELECT *, CASE WHEN k % 3 = 2 THEN k - 1 ELSE k END AS p FROM ({ROWS}) y), f AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY t) AS n FROM x), w AS (SELECT *, '/e/' || p::VARCHAR AS path, CASE WHEN k % 4 = 0 THEN 'Unknown' ELSE 'T' || t END AS category FROM f WHERE n = 1)
    SELECT 'POST:' || path AS eid, 'POST' AS method, path, category, 'op' || t AS operation_id, 's' AS summary, 'long' AS description, 'a,b' AS tags, true AS deprecated,
    '[{{"name":"p","in":"query","required":false,"schema":' || {_S} || ',"description":"d"}},{{"name":"n","in":"path","required":true,"schema":{{}},"description":""}},{{"name":"","in":"","required":false,"schema":{{}},"description":""}},{{"name":"","in":"","required":false,"schema":{{}},"description":""}}]' AS parameters,
    '{{"allOf":[' || {_S} || ',{{"$ref":"#/components/schemas/None"}}]}}' AS request_body, '[{{"status":"200","description":"fine","schema":{{}}}},{{"status":"404","description":"none","schema":null}}]' AS responses FROM w
    UNION ALL SELECT 'GET:' || path, 'GET', path, category, '', '', '', '', false, '[]', NULL, '[{{"status":"default","description":"","schema":' || {_S} || '}}]' FROM w"""
)
def ep_1_whole_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EP-1, ST-4: endpoints with tags and all parts, references expanded; the first document of a method and path wins."""
    return details.endpoint_details(_documents(spark, sf_dir, _OPERATIONS)).withColumn("tags", F.array_join("tags", ","))


_MODELS = "SELECT id AS pointer, id AS ord, name AS label, yang_path, required, type, CASE WHEN device_types IS NULL THEN '' ELSE device_types END AS device, CASE WHEN required THEN 'x' ELSE '' END AS note, component_id AS owner FROM b_property"


@query(
    f"""WITH m AS (SELECT *, CASE WHEN yang_path <> '' THEN 'yang:' || yang_path ELSE 'property:' || lower(label) END AS identity FROM ({_MODELS}) e), l AS (SELECT identity, col, v, min(ord) AS o FROM (SELECT identity, ord, 'p' AS col, pointer AS v FROM m UNION ALL SELECT identity, ord, 't', type FROM m UNION ALL SELECT identity, ord, 'd', device FROM m UNION ALL SELECT identity, ord, 'd', note FROM m) u WHERE v <> '' GROUP BY ALL),
    g AS (SELECT identity, string_agg(v, ',' ORDER BY o, CASE WHEN v = 'x' THEN 1 ELSE 0 END) FILTER (col = 'p') AS pointers, string_agg(v, ',' ORDER BY o) FILTER (col = 't') AS types, string_agg(v, ',' ORDER BY o, CASE WHEN v = 'x' THEN 1 ELSE 0 END) FILTER (col = 'd') AS marks FROM l GROUP BY identity)
    SELECT m.identity, coalesce(arg_min(label, ord) FILTER (label <> ''), '') AS label, arg_min(note, ord) FILTER (note <> '') AS note, bool_or(required) AS required, count(*) AS n, coalesce(max(pointers), '') AS pointers, coalesce(max(types), '') AS types, coalesce(max(marks), '') AS marks FROM m JOIN g ON g.identity = m.identity GROUP BY m.identity"""
)
def ag_8_merged_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-8, SM-6: rows of one identity merged: first filled values, lists joined by first appearance, required if any is."""
    rows = frame(spark, sf_dir, _MODELS).withColumn("identity", merge.identity_key(F.col("yang_path"), F.col("label"), F.col("pointer"), "property")).withColumn("marks", F.array("device", "note"))
    found = details.merged_models(rows, ["label", "note"], {"pointer": "pointers", "type": "types", "marks": "marks"})
    return found.select("identity", "label", "note", "required", "n", *(F.array_join(c, ",").alias(c) for c in ("pointers", "types", "marks")))


_BUILT = "SELECT CASE WHEN ord % 6 = 1 THEN id || '#items' ELSE id END AS id, kind, CASE WHEN kind = 'unresolved' THEN '' ELSE kind END AS shape FROM b_component"


@query(
    f"""WITH c AS ({_BUILT}), p AS (SELECT component_id AS id, count(*) AS p FROM b_property GROUP BY 1), r AS (SELECT count(*) AS n_components, count_if(NOT contains(c.id, '#')) AS n_named, count_if(contains(c.id, '#')) AS n_inline, count_if(kind = 'unresolved') AS n_unresolved, coalesce(sum(p), 0)::BIGINT AS n_properties,
    count_if(NOT contains(c.id, '#') AND shape = 'object' AND p IS NULL) AS n_empty_named FROM c LEFT JOIN p ON p.id = c.id) SELECT *, round(n_properties / greatest(n_named, 1), 2) AS properties_per_named, round(n_empty_named / greatest(n_named, 1) * 100, 1) AS empty_named_pct FROM r"""
)
def ag_16_build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG-16: named, inline and unresolved components, properties for each named one, named objects without any."""
    return details.build_report(frame(spark, sf_dir, _BUILT), frame(spark, sf_dir, "SELECT id, component_id FROM b_property"))


_NODES = """[('/components/schemas/A' || t, 'Schema', false, 'object', '', '{"required":["s","n","s","gone",5]}', '{}'), ('/components/schemas/A' || t || '/properties/o', 'Schema', false, 'object', '', '{"required":["i"]}', '{}'), ('/components/schemas/A' || t || '/properties/o', 'Property', false, 'object', '', '{"required":["i"]}', '{}'),
    ('/components/schemas/A' || t || '/properties/o/properties/i', 'Property', true, 'boolean', '', '{"readOnly":"yes"}', '{}'), ('/components/schemas/A' || t || '/properties/o/properties/properties', 'Property', false, '', '', '{}', '{}'), ('/components/schemas/A' || t || '/properties/p', 'Property', false, '', '', '{}', '{}'),
    ('/components/schemas/A' || t || '/properties/g', 'Property', false, '', '', '{}', '{"x-b":true}'), ('/components/schemas/A' || t || '/properties/r', 'Property', false, '', 'own', '{}', '{"x-a":1,"x-path":5}'),
    ('/components/schemas/A' || t || '/properties/s', 'Property', true, 'string', 'd' || t, '{"default":{"a":2,"z":1},"enum":["x",1,2.5,true,null,[]],"maxLength":9,"minLength":2,"pattern":"^a","x-key":["k"]}', '{"x-key":["k"],"x-path":"/m' || (k % 4)::VARCHAR || ':top/s","x-supportedDeviceType":["AP",1,"SWITCH"]}'),
    ('/components/schemas/A' || t || '/properties/n', 'Property', true, 'integer', '', '{"default":null,"maximum":true,"minLength":"3","minimum":1.5,"readOnly":true,"x-enumDescriptions":{"1":"one"}}', '{"x-enumDescriptions":{"1":"one"}}'),
    ('/components/schemas/E', 'Schema', false, 'string', 'e', '{"enum":["e"],"readOnly":true}', '{"x-a":2,"x-c":{"a":[1],"b":1},"x-supportedDeviceType":"GW"}'), ('/components/schemas/C', 'Schema', false, '', '', '{}', '{}'), ('/components/schemas/C/properties/c', 'Property', false, '', repeat('w', (k % 4)::INT), '{}', '{}'),
    ('/paths/~1p~1' || t || '/get/responses/200/content/application~1json/schema', 'Schema', false, 'object', '', '{}', '{}'), ('/paths/~1p~1' || t || '/get/responses/200/content/application~1json/schema/properties/q', 'Property', false, '', '', '{}', '{}')]"""
_ALL_NODES = f"""SELECT t AS source, unnest(CASE WHEN k % 4 = 0 THEN [('/components/schemas/C/properties/d', 'Property', false, '', '', '{{}}', '{{}}')] ELSE [] END || CASE WHEN k % 5 = 0 THEN [('/components/schemas/Pool', 'Schema', false, 'number', repeat('p', (k % 3)::INT), '{{}}', '{{}}')] ELSE [] END || {_NODES}) AS v FROM ({ROWS}) x"""


@query(f"SELECT source, v[2] AS kind, v[1] AS pointer, v[3] AS required, v[4] AS type, v[5] AS description, v[6] AS constraints, v[7] AS extensions FROM ({_ALL_NODES}) y")
def sm_1_node_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-1, SM-2, SM-5: overlay nodes of schemas and properties with required marks, constraints and extensions."""
    ast = shared_checkpoint(specs.flatten(_documents(spark, sf_dir, _FIELDS), details.SUMMARY_KEYS, details.SUMMARY_KINDS))
    return details.node_summaries(ast).drop("spec_id", "node_id")


@query(f"""SELECT source, 'SEMANTIC_DERIVED_FROM' AS kind, v[2] AS node_kind, v[1] AS pointer, '{{"pointer":"' || v[1] || '"}}' AS evidence FROM ({_ALL_NODES}) y""")
def sm_7_provenance_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM-7: from every overlay node to the value it stands for, with the node and the value looked up again by their ids."""
    # of the rows, those that nodes are made of and stand for, with their document's source; only a node's id, kind and place are used
    ast = shared_checkpoint(specs.flatten(_documents(spark, sf_dir, _FIELDS), details.SUMMARY_KEYS, details.SUMMARY_KINDS))
    nodes = shared_checkpoint(details.node_summaries(ast).select("node_id", "spec_id", "kind", "pointer"))
    values = ast.where(F.col("kind").isin("Schema", "Items", "Property") & (F.col("value_type") == "object")).select("spec_id", "source", "pointer")
    edges = details.provenance_edges(nodes, values)
    values = values.select(F.concat_ws("#", "spec_id", "pointer").alias("target"), "source", "pointer")
    return edges.join(nodes.select(F.col("node_id").alias("source"), F.col("kind").alias("node_kind")), "source").drop("source").join(values, "target").select("source", "kind", "node_kind", "pointer", "evidence")


_SHAPE = """'{"type":"object","title":"T ' || t || '","properties":{"a":{},"b":{},"c":{"type":"integer","default":' || q || '7' || q || '}}}'"""
_REPEATED = f"""'{{"paths":{{"/a":{{"get":{{"responses":{{"404":{{"description":"e' || t || '"}},"200":{{"_x":1,"content":{{"application/json":{{"schema":' || {_SHAPE} || '}}}}}}}}}}}},"/b":{{"get":{{"responses":{{"404":{{"description":"e' || t || '"}},"418":{{"description":"tea"}},"200":{{"content":{{"application/json":{{"schema":' || {_SHAPE} || '}}}}}}}}}}}},'
    || '"/c":{{"get":{{"responses":{{"418":{{"description":"tea"}}}}}}}}}}}}'"""
_DIGEST = """substring(sha1('{"properties":{"a":{},"b":{},"c":{"default":7,"type":"integer"}},"title":"T ' || t || '","type":"object"}'), 1, 8)"""


@query(
    f"""WITH x AS (SELECT t, '' AS q, 'Error404_' || substring(sha1('{{"description":"e' || t || '"}}'), 1, 8) AS e, 'T' || t || '_' || {_DIGEST} AS s FROM ({ROWS}) y), z AS (SELECT *, '{{"$ref":"#/components/responses/' || e || '"}}' AS er, '{{"content":{{"application/json":{{"schema":{{"$ref":"#/components/schemas/' || s || '"}}}}}}}}' AS sr FROM x)
    SELECT t AS source, '{{"paths":{{"/a":{{"get":{{"responses":{{"404":' || er || ',"200":' || sr || '}}}}}},"/b":{{"get":{{"responses":{{"404":' || er || ',"418":{{"description":"tea"}},"200":' || sr || '}}}}}},"/c":{{"get":{{"responses":{{"418":{{"description":"tea"}}}}}}}}}},"components":{{"responses":{{"' || e || '":{{"description":"e' || t || '"}}}},"schemas":{{"' || s || '":' || {_SHAPE} || '}}}}}}' AS raw, true AS same FROM z"""
)
def cl_7_normalised_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CL-1, CL-3, CL-5..7: whole normalised documents: cleaned, repeated error responses and shapes named by their content; a second time changes nothing."""
    raw = frame(spark, sf_dir, f"""SELECT 'made' AS spec_source, t AS source, 'n' AS title, {_REPEATED} AS raw FROM (SELECT *, '"' AS q FROM ({dealt(spark, ROWS)}) y) x""")
    once = shared_checkpoint(specs.normalised(raw))
    again = specs.normalised(once).select("source", F.col("raw").alias("again"))
    return once.join(again, "source").select("source", "raw", (F.col("raw") == F.col("again")).alias("same"))
