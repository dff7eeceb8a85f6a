"""Operators without a checking SQL, on small hand-made inputs, and properties that hold for any input order."""

import json
import math
import random
import re
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from specgraph.functions import jsonwalk
from specgraph.functions.expand import Expansion
from specgraph.functions.views import Views
from specgraph.functions.shapes import shape_hash
from specgraph.operators import parts as operation_parts
from specgraph.operators import audit, details, discover, inventory, merge, models, projection, search, specs, topology, walk
from specgraph.plans import discovery, registry  # noqa: F401
from specgraph.plans import sources as source_plans  # noqa: F401
from specgraph.sources import documents, sinks
from tests.conftest import DATA

SPEC = {
    "openapi": "3.0.3",
    "info": {"title": "Things", "version": "2"},
    "tags": [{"name": "t"}],
    "paths": {
        "/things/{id}": {
            "parameters": [{"name": "id", "in": "path", "required": True, "schema": {"type": "string"}}, {"name": "filter", "in": "query", "schema": {"type": "string"}}],
            "post": {
                "operationId": "make", "summary": "make a thing", "parameters": [{"name": "filter", "in": "query", "required": True, "schema": {"type": "string"}}],
                "requestBody": {"content": {"application/json": {"schema": {"$ref": "#/components/schemas/Thing"}}, "text/plain": {"schema": {"type": "string"}}}},
                "responses": {"200": {"description": "ok", "content": {"application/json": {"schema": {"$ref": "#/components/schemas/Thing"}}}}, "400": {"description": "bad"}},
            },
            "get": {"responses": {"400": {"description": "bad"}}},
        }
    },
    "components": {
        "schemas": {
            "Thing": {
                "type": "object", "description": "either `a` or `b`", "required": ["a", "deep", "list"],
                "properties": {
                    "a": {"type": "string", "default": "x", "description": "prose"}, "b": {"type": "boolean", "default": "true"}, "description": {"type": "string"},
                    "deep": {"type": "object", "required": ["z"], "properties": {"z": {"$ref": "#/components/schemas/Leaf"}}}, "list": {"type": "array", "items": {"type": "object", "required": ["q"], "properties": {"q": {"type": "integer"}}}},
                    "self": {"$ref": "#/components/schemas/Thing"}, "gone": {"$ref": "#/components/schemas/Gone"},
                },
            },
            "Leaf": {"type": "string", "enum": ["u", "v"], "oneOf": [{"type": "string"}]},
            "Map": {"additionalProperties": {}},
        }
    },
}


def corpus(spark, *documents_):
    return spark.createDataFrame([(f"p{i % 2}", f"s{i}", "t", d if isinstance(d, str | None) else json.dumps(d)) for i, d in enumerate(documents_)], "spec_source string, source string, title string, raw string")


def test_walk_kinds_and_round_trip():
    rows = {r[0]: r for r in jsonwalk.walk(SPEC)}
    kinds = {p: r[4] for p, r in rows.items()}
    base = "/paths/~1things~1{id}"
    assert kinds[""] == "Document" and kinds[base] == "PathItem" and kinds[f"{base}/post"] == "Operation" and kinds[f"{base}/parameters/0"] == "Parameter" and kinds["/tags/0"] == "Tag"
    assert kinds[f"{base}/post/requestBody/content/application~1json"] == "MediaType" and kinds[f"{base}/post/responses/200"] == "Response"
    thing = "/components/schemas/Thing"
    assert kinds[thing] == "Schema" and kinds[f"{thing}/properties/a"] == "Property" and kinds[f"{thing}/properties/list/items"] == "Items" and kinds[f"{thing}/required"] == "Constraint"
    assert jsonwalk.rebuild([(r[0], r[1], r[2], r[5], r[7]) for r in rows.values()]) == SPEC
    assert rows[f"{base}/post"][6] == "make" and rows[f"{thing}/properties/a/default"][7] == '"x"'


def test_cleaning():
    raw = {"_x": 1, "type": "integer", "default": "7", "description": " d ", "x-typeDescription": "d", "format": "const", "maxLength": 9999, "x-patternSources": [1] * 5, "in": [{"_y": 2, "type": "number", "default": "no"}]}
    assert jsonwalk.cleaned(raw) == {"type": "integer", "default": 7, "description": " d ", "in": [{"type": "number", "default": "no"}]}
    assert jsonwalk.cleaned(SPEC)["components"]["schemas"]["Thing"]["x-mutually-exclusive"] == ["a", "b"]
    assert jsonwalk.coerced("0", "boolean") is False and jsonwalk.coerced("1.5", "number") == 1.5 and jsonwalk.coerced("q", "boolean") == "q"


def test_repeated_parts_become_components_and_expand_back():
    rule = {"type": "object", "properties": {"a": {"type": "string"}, "b": {"type": "string"}, "c": {"type": "object", "properties": {"x": {}, "y": {}, "z": {}}}}}
    error = {"description": "bad", "content": {}}
    doc = {"paths": {f"/p{i}": {"get": {"responses": {"200": {"description": "ok", "content": {"application/json": {"schema": json.loads(json.dumps(rule))}}}, "404": dict(error)}}} for i in range(12)}}
    once = jsonwalk.shared(doc)
    assert jsonwalk.shared(once) == once and len(once["components"]["responses"]) == 1 and len(once["components"]["schemas"]) >= 1
    assert expanded({"paths": once["paths"]}, once) == doc and len(json.dumps(once)) < len(json.dumps(doc))


def test_all_repeated_shapes_are_shared_however_many():
    def shape(k, inner):
        return {"type": "object", "title": f"T {k}", "properties": {f"p{k}": {}, "q": {}, "r": inner}}

    doc = {"paths": {f"/p{i}": {"post": {"requestBody": {"content": {"application/json": {"schema": shape(i % 20, shape(100 + i % 20, {}))}}}, "responses": {"4XX": {"description": "no"}, "200": {"description": "no"}}}} for i in range(60)}}
    once = jsonwalk.shared(doc)
    names = once["components"]["schemas"]
    assert len(names) == 40 and all(n.startswith("T") for n in names) and list(once["components"]["responses"])[0].startswith("Error4XX_")
    assert jsonwalk.shared(once) == once and expanded({"paths": once["paths"]}, once) == doc
    clash = dict(doc, components={"schemas": {n: {"type": "string"} for n in names}})
    again = jsonwalk.shared(clash)
    assert len(again["components"]["schemas"]) == 80 and expanded({"paths": again["paths"]}, again) == doc


def expanded(value, document, depth=15):
    return json.loads(Expansion(document, depth).text(value, 1 << 30)[0])


def test_projections_of_one_operation():
    got = Views(SPEC)
    paths = got.skeleton("/things/{id}", "post")["required_paths"]
    assert paths[:4] == ["a", "deep.z", "list[].q", "self.a"] and len(paths) == 45  # 15 times: an optional member of its own kind
    parts, glossary = got.components("/things/{id}", "post"), got.glossary("/things/{id}", "post")
    thing = parts["schemas"]["Thing"]
    assert set(parts["schemas"]) == {"Thing", "Leaf"} and "description" not in thing and "description" in thing["properties"]
    assert glossary["components"]["Thing"] == {"description": "either `a` or `b`", "properties": {"a": {"description": "prose"}}}
    looped = expanded({"$ref": "#/components/schemas/Thing"}, SPEC, 2)
    assert looped["properties"]["self"]["properties"]["self"] == {"$circular_ref": True}


def test_required_paths_below_optional_members():
    parts = {"O": {"type": "object", "required": ["k"], "properties": {"k": {}, "l": {"type": "array", "items": {"$ref": "#/components/schemas/O"}}}}}
    schema = {"required": ["a", "b", 5, "gone"], "properties": {
        "x": {"type": "object", "required": ["y"], "properties": {"y": {"type": "object"}}}, "a": {"type": "array"}, "b": {"type": "array", "items": {"required": ["c"], "properties": {}}}, "z": {"type": "array", "items": {"required": ["w"]}}, "n": "odd",
        "all": {"allOf": [{"required": ["hidden"]}]}}}
    assert Views({}).required_paths(schema) == ["a", "b[].c", "gone", "x.y", "z[].w"]
    deep = Views({"components": {"schemas": parts}}).required_paths({"$ref": "#/components/schemas/O"})
    assert deep[:3] == ["k", "l[].k", "l[].l[].k"] and len(deep) == 15
    assert Views({}).required_paths({"required": 5, "properties": []}) == Views({}).required_paths("odd") == []


def test_expansion_equals_plain_recursion():
    parts = {f"K{i}": {"x": {"$ref": f"#/components/schemas/K{i + 1}"}, "y": [{"$ref": "#/components/schemas/T"}, {"$ref": "#/none"}]} for i in range(20)} | {"K20": {"e": 'q"é'}, "T": {"t": {"$ref": "#/components/schemas/K18"}}, "L": {"l": {"$ref": "#/components/schemas/L"}, "m": {"$ref": "#/components/schemas/Gone"}}}
    document = {"components": {"schemas": parts}}

    def plain(v, depth=0):
        if depth > 15:
            return {"$circular_ref": True}
        if isinstance(v, list):
            return [plain(x, depth) for x in v]
        if not isinstance(v, dict):
            return v
        named = parts.get(v["$ref"].removeprefix("#/components/schemas/")) if "$ref" in v else None
        return plain(named, depth + 1) if named is not None else {k: plain(x, depth) for k, x in v.items()}

    once = Expansion(document)
    for name in ("K0", "K3", "K5", "K10", "T", "L"):
        assert json.loads(once.text(parts[name], 1 << 30)[0]) == plain(parts[name])
    bushy = {"components": {"schemas": {f"B{i}": [{"$ref": f"#/components/schemas/B{i + 1}"}] * 8 for i in range(12)} | {"B12": 1}}}
    text, size = Expansion(bushy).text({"$ref": "#/components/schemas/B0"}, 1000)
    assert text is None and size == sum(2 * 8**i + 7 * 8**i for i in range(12)) + 8**12


def test_no_document_breaks_a_walk():
    for text, outcome in (("[" * 100_000, "too deep"), ('{"a":' * 6000 + "1" + "}" * 6000, "too deep"), ('{"a": NaN}', "broken"), ("{", "broken"), (None, "broken"), ("[1]", "not an object"), ('{"a":' * 4900 + "1" + "}" * 4900, "ok")):
        assert jsonwalk.parsed(text)[1] == outcome
    deep = {"paths": {"/a": {"post": {"requestBody": {"content": {"application/json": {"schema": {}}}}}}}}
    schema = deep["paths"]["/a"]["post"]["requestBody"]["content"]["application/json"]["schema"]
    for _ in range(1200):
        schema |= {"type": "object", "required": ["p"], "description": "d", "properties": {"p": {}}}
        schema = schema["properties"]["p"]
    assert jsonwalk.cleaned(deep) == deep and jsonwalk.shared(deep)["paths"] == deep["paths"] and len(list(jsonwalk.walk(deep))) > 3600
    assert Views(deep).skeleton("/a", "post")["required_paths"][0].count(".") == 1199 and expanded(deep, deep) == deep and Views(deep).glossary("/a", "post")["components"]
    assert jsonwalk.cleaned({"type": "number", "default": "nan"}) == {"type": "number", "default": "nan"}
    odd = {"paths": {"/a": {"get": {"parameters": [5, {"name": 7}], "requestBody": {"content": {"application/json": "text"}}, "responses": {"200": "text", "404": []}}, "post": "text"}, "/b": []}, "components": []}
    for path, method in (("/a", "get"), ("/a", "post"), ("/b", "get"), ("/c", "get")):
        assert Views(odd).skeleton(path, method)["request_body"] is None and Views(odd).components(path, method) == {} and Views(odd).glossary(path, method)["components"] == {}


def test_hints_and_errors_that_are_given_stay():
    def at(schema):
        return {"paths": {"/a": {"get": {"x": schema}}}}

    both = {"p": {}, "q": {}}
    given = {"description": "either p or q", "properties": both, "x-mutually-exclusive": ["z"]}
    assert jsonwalk.cleaned(at(given)) == at(given)
    assert jsonwalk.cleaned(at({"description": "either p, or q; either p or q", "properties": both}))["paths"]["/a"]["get"]["x"]["x-mutually-exclusive"] == ["p", "q"]
    assert "x-mutually-exclusive" not in jsonwalk.cleaned({"x": {"description": "either p or q", "properties": both}})["x"]
    teapot = {"paths": {f"/{i}": {"get": {"responses": {"418": {"description": "t"}, "5xx": {"description": "u"}}}} for i in range(2)}}
    assert list(jsonwalk.shared(teapot)["components"]["responses"])[0].startswith("Error5xx_") and len(jsonwalk.shared(teapot)["components"]["responses"]) == 1


def test_skeleton_keeps_one_success_and_the_first_referenced_error():
    spec = {
        "paths": {"/a": {"get": {"summary": "s", "parameters": [{"$ref": "#/components/parameters/q"}, "bad"], "responses": {
            "299": {"description": "no"}, "400": {"description": "inline"}, "404": {"$ref": "#/components/responses/E"}, "201": {"$ref": "#/components/responses/Made"}, "500": {"$ref": "#/components/responses/F"}}}}},
        "components": {"parameters": {"q": {"name": "q", "in": "query", "description": "d", "schema": {"type": "string"}}}, "responses": {"Made": {"content": {"application/json": {"schema": {"type": "object", "description": "d"}}}}, "E": {"description": "e"}}},
    }
    got = Views(spec).skeleton("/a", "get")
    assert got["responses"] == {"201": {"schema": {"type": "object"}}, "error": {"status": "404", "$ref": "#/components/responses/E"}}
    assert got["parameters"] == [{"name": "q", "in": "query", "required": False, "schema": {"type": "string"}}]
    assert (got["summary"], got["request_body"], got["$components_index"]) == ("s", None, {"responses": {"E": {}}})
    assert Views({"paths": {"/a": {"get": {"responses": None, "parameters": None}}}}).skeleton("/a", "get")["responses"] == {}


def test_rows_of_a_document(spark):
    docs = corpus(spark, SPEC, "[1]", "{broken", None)
    ast, rows = specs.flatten(docs), specs.spec_rows(docs)
    ends = specs.endpoint_rows(ast, rows)
    assert {r["eid"] for r in ends.collect()} == {"POST:/things/{id}", "GET:/things/{id}"} and rows.count() == 1
    params = {(r["eid"][:3], r["name"]): (r["required"], r["hint"]) for r in operation_parts.parameter_rows(ast, rows, ends).collect()}
    assert params == {("POS", "id"): (True, ""), ("POS", "filter"): (True, "odata-filter"), ("GET", "id"): (True, ""), ("GET", "filter"): (False, "odata-filter")}
    media = operation_parts.media_rows(ast, rows, ends)
    # responses without content have a row without a media type
    assert media.where("media <> ''").count() == 3 and media.where("media = ''").count() == 2
    assert {r["media"] for r in operation_parts.main_media(media).collect()} == {"application/json", ""}
    parts = {r["name"]: (r["kind"], r["shape"]) for r in specs.component_rows(ast, rows).collect()}
    assert parts == {"Thing": ("object", "object"), "Leaf": ("primitive", "primitive"), "Map": ("map", "map"), "Gone": ("unresolved", "")}
    props = {r["name"]: r["required"] for r in specs.property_rows(ast, rows).collect()}
    assert props == {"a": True, "b": False, "description": False, "deep": True, "list": True, "self": False, "gone": False}
    inline = {(r["id"], r["parent_id"], r["role"]) for r in projection.inline_components(ast, rows).collect()}
    assert ("p0:schemas:Thing#prop:deep", "p0:schemas:Thing", "object") in inline and ("p0:schemas:Thing#prop:list#items", "p0:schemas:Thing#prop:list", "items") in inline
    status = {r["status"]: r["n"] for r in specs.outcomes(docs).groupBy("status").agg(F.sum("n").alias("n")).collect()}
    assert status == {"ok": 1, "not an object": 1, "broken": 2}
    assert projection.shared_objects(specs.flatten(corpus(spark, {"a": {"properties": {"x": 1, "y": 1, "z": 1}}, "b": 1})), least=1).count() == 0


def test_rows_do_not_depend_on_order_or_partitions(spark):
    other = json.loads(json.dumps(SPEC).replace("make a thing", "other").replace('"v"', '"v", "w"'))
    docs = [SPEC, other, SPEC]
    want = None
    for order, parts in (((0, 1, 2), 1), ((2, 1, 0), 3), ((1, 0, 2), 2)):
        rows = corpus(spark, *docs).collect()
        df = spark.createDataFrame([rows[i] for i in order], "spec_source string, source string, title string, raw string").repartition(parts)
        ast, own = specs.flatten(df), specs.spec_rows(df)
        got = sorted(map(tuple, specs.component_rows(ast, own).collect())), sorted(map(tuple, specs.endpoint_rows(ast, own).drop("spec_id").collect()))
        want = want or got
        assert got == want


def test_richest_wins_in_either_order(spark):
    rows = [("p", "s", "N", "short", 1), ("p", "s", "N", "longer body", 2), ("p", "s", "N", "other  body", 3)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, "provider string, section string, name string, body string, ord int")
        assert [r["body"] for r in merge.longest_wins(df, ["provider", "section", "name"]).collect()] == ["longer body"]
        ids = merge.catalogue_ids(df).collect()
        assert sum(r["is_primary"] for r in ids) == 1 and len({r["id"] for r in ids}) == 3


def distances(nodes, pairs, start):
    """Steps from one node to each that it reaches."""
    seen, front = {start: 0}, {start}
    while front:
        front = {m for n in front for p in pairs if n in p for m in p if m in nodes} - seen.keys()
        seen |= dict.fromkeys(front, max(seen.values()) + 1)
    return seen


def test_bridges_cut_nodes_and_distances_by_removal(spark):
    """Sixty sites of any shape at once."""
    rng = random.Random(2)

    def parts(nodes, pairs):
        left, n = set(nodes), 0
        while left:
            left -= distances(left, [p for p in pairs if set(p) <= set(nodes)], min(left)).keys()
            n += 1
        return n

    sites, want_bridges, want_cuts, want_far = {}, set(), set(), {}
    for s in range(60):
        nodes = list(range(rng.randint(1, 14)))
        pairs = sorted(p for p in combinations(nodes, 2) if rng.random() < (0.22, 0.4, 0.12)[s % 3])
        sites[str(s)] = nodes, pairs
        want_bridges |= {(str(s), *p) for p in pairs if parts(nodes, [q for q in pairs if q != p]) > parts(nodes, pairs)}
        want_cuts |= {(str(s), n) for n in nodes if parts([m for m in nodes if m != n], pairs) > parts(nodes, pairs)}
        far = [d for n in nodes for d in distances(nodes, pairs, n).values()]
        want_far[str(s)] = (max(far), sum(far))
    nodes = spark.createDataFrame([(s, n) for s, (ns, _) in sites.items() for n in ns], "site_id string, node long")
    edges = spark.createDataFrame([(s, *e) for s, (_, ps) in sites.items() for p in ps for e in (p, p[::-1], (p[0], p[0]))], "site_id string, u long, v long")
    links = topology.blocks(nodes, edges)[0]
    assert {tuple(r) for r in topology.bridges(links).collect()} == want_bridges and {tuple(r) for r in topology.cut_nodes(links).collect()} == want_cuts
    assert {r["site_id"]: (r["far"], r["steps"]) for r in topology.path_lengths(nodes, edges).collect()} == want_far
    pairs = topology.simple_edges(edges)
    small = {r["site_id"]: tuple(r)[1:] for r in topology.small_sites(nodes, pairs).collect()}
    assert {s: x[:2] for s, x in small.items()} == want_far
    assert {(s, *map(int, b.split("-"))) for s, x in small.items() for b in x[2].split(",") if b} == want_bridges and {(s, int(n)) for s, x in small.items() for n in x[3].split(",") if n} == want_cuts


def test_site_metrics(spark):
    nodes = spark.createDataFrame([("a", i) for i in range(4)] + [("b", 1)], "site_id string, node long")
    edges = spark.createDataFrame([("a", 0, 1), ("a", 1, 0), ("a", 1, 2), ("a", 2, 3), ("a", 3, 3)], "site_id string, u long, v long")
    got = {r["site_id"]: r for r in topology.site_metrics(nodes, edges).collect()}
    assert (got["a"]["n_edges"], got["a"]["diameter"], got["a"]["avg_path"], got["a"]["bridges"], got["a"]["cut_nodes"]) == (3, 3, 1.67, "0-1,1-2,2-3", "1,2")
    assert got["b"]["connected"] and got["b"]["diameter"] == 0


def test_walks_on_a_cycle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "a int, b int")
    roots = spark.createDataFrame([(1,), (9,)], "root int")
    assert {(r["root"], r["node"], r["depth"]) for r in walk.within(roots, edges, 2).collect()} == {(1, 1, 0), (1, 2, 1), (1, 3, 2), (9, 9, 0)}
    assert {(r["root"], r["node"]) for r in walk.closure(roots, edges).collect()} == {(1, 1), (1, 2), (1, 3), (1, 4), (9, 9)}


def test_page_sections_and_paging(spark):
    html = "<body><nav>x</nav><main id='main-content'><p>intro</p><script>s()</script><h1 id='one'>One</h1><p>a<br>b</p><details>no</details><h2>Two words</h2><ul><li>c</li></ul></main></body>"
    assert documents.sections(html, "pg", "main-content") == [("pg-intro", "One — Introduction", "intro", ""), ("pg-one", "One", "a\nb", "#one"), ("pg-two-words", "Two words", "c", "")]
    # no heading, a nameless and an empty section, items that are left open, a root that is never closed
    assert documents.sections("<main>some <b>text</b></main>x", "a-page", "main") == [("a-page", "A Page", "some text", "")]
    assert documents.sections("<div id=m><h1>A</h1><p> </p><h2></h2>x<h2>B</h2><li>y<li>z</div><h2>C</h2>out", "p", "m") == [("p-b", "B", "y\nz", "")]
    assert documents.sections("<div id=m><h1>A</h1>x", "p", "m") == [("p-a", "A", "x", "")]
    assert documents.sections("<p>x</p>", "pg", "main-content") == [] == documents.sections(None, "pg", "main")
    pages = spark.createDataFrame([("a", 1, 5, 9), ("a", 2, 0, 9), ("b", 1, 5, 9), ("c", 1, 5, 5)], "source string, page int, n int, total int")
    assert {r["source"]: r["truncated"] for r in documents.paging_report(pages, "source", "page", "n", "total").collect()} == {"a": False, "b": True, "c": False}
    bodies = spark.createDataFrame([(1, '{"name":"x"}'), (2, '{"items":[{"a":1},{"a":2}]}'), (3, "broken"), (4, "[]")], "k int, body string")
    assert sorted((r["k"], r["item"]) for r in documents.response_items(bodies, "body").collect()) == [(1, '{"name":"x"}'), (2, '{"a":1}'), (2, '{"a":2}')]


def test_corpus_folder(spark, tmp_path):
    for name, text in {"p/a.json": json.dumps(SPEC), "p/b.json": "[]", "p/c.yaml": "info: {title: Y}\npaths: {/a: {}, /b: {}}", "q/d.json": "{", "q/e.txt": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    rows = {r["source"]: r for r in documents.load_corpus(spark, str(tmp_path), first_paths=1).collect()}
    assert rows["p/a.json"]["title"] == "Things" and set(rows) <= {"p/a.json", "p/c.yaml"}
    report = {(r["spec_source"], r["status"]): r["n"] for r in documents.corpus_report(spark, str(tmp_path)).collect()}
    assert report.pop(("p", "no reader"), 0) + report[("p", "ok")] - 1 in (0, 1) and report[("p", "not an object")] == report[("q", "broken")] == 1
    assert documents.read_document("x.json", b"\xff")[1] == "broken" and documents.read_document("x.json", b"{}") == ({}, "ok")
    assert documents.load_corpus(spark, str(tmp_path), first=1).count() == 1


def test_sink_null_rule_and_unique_keys(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("flag", T.BooleanType()), T.StructField("n", T.LongType()), T.StructField("types", T.ArrayType(T.StringType()))])
    df = spark.createDataFrame([("a", None, None), ("b", 1, True)], "id string, n int, flag boolean")
    sinks.write_table(df, str(tmp_path / "t"), schema, "id", frozenset(["types"]), bucket="id")
    row = spark.read.parquet(str(tmp_path / "t")).where("id = 'a'").first()
    assert (row["tags"], row["flag"], row["n"], row["types"]) == ([], False, None, None)
    with pytest.raises(sinks.DuplicateKeyError):
        sinks.write_table(df.union(df), str(tmp_path / "u"), schema, "id")


def test_gate_and_search_edges(spark):
    offenders = spark.createDataFrame([("x",), ("y",)], "detail string")
    report = audit.invariant("one", offenders).unionByName(audit.invariant("none", offenders.limit(0)))
    assert {r["invariant"]: (r["n"], r["sample"]) for r in report.collect()} == {"one": (2, "x,y"), "none": (0, "")}
    with pytest.raises(audit.InvariantError, match="one: 2"):
        audit.gate(report)
    audit.gate(report.where("n = 0"))
    rows = spark.createDataFrame([(1, "a b a", False), (2, None, False), (3, "", True)], "ord int, summary string, deprecated boolean")
    queries = spark.createDataFrame([("q", "a")], "query string, term string")
    assert [r["doc"] for r in search.bm25(rows, "ord", F.col("summary"), queries).collect()] == [1]
    assert search.keyword_search(rows, ["a"]).count() == 1


def test_whole_blobs_are_decoded(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    got = {r["doc_id"]: r["json"] for r in registry.QUERIES["sg_12_decode_whole_blobs"](spark, f"{DATA}/sf0.001").collect()}
    assert got == {i: "b64:%%%" if i % 3 == 1 else t for i, t in texts.items()} and max(len(t) for i, t in got.items() if i % 3 == 0) > 76


def test_keyword_reaches_endpoints_that_only_return_a_component(spark):
    found = {tuple(r) for r in registry.QUERIES["tk_4_keyword_to_any_endpoint"](spark, f"{DATA}/sf0.001").select("property_id", "eid").collect()}
    bodies = {tuple(r) for r in registry.QUERIES["tk_4_keyword_to_endpoint"](spark, f"{DATA}/sf0.001").select("property_id", "eid").collect()}
    assert bodies < found and any(eid and eid.startswith("GET:") for _, eid in found) and not any(eid.startswith("GET:") for _, eid in bodies)


def test_path_lengths_in_groups(spark, monkeypatch):
    """Distances do not depend on how starts are numbered, and no size leaves them out."""
    monkeypatch.setattr(topology, "SMALL", 20)
    monkeypatch.setattr(topology, "GROUP", 9)
    monkeypatch.setattr(topology, "WORD", 4)
    pairs = [(i, i + 1) for i in range(40)] + [(0, 17), (5, 33), (21, 40)]
    far = [distances(list(range(41)), pairs, n) for n in range(41)]
    nodes = spark.createDataFrame([("a", i) for i in range(41)] + [("b", 1)], "site_id string, node long")
    edges = spark.createDataFrame([("a", u, v) for u, v in pairs] + [("b", 1, 1)], "site_id string, u long, v long")
    got = {r["site_id"]: r for r in topology.site_metrics(nodes, edges).collect()}
    assert got["a"]["diameter"] == max(max(f.values()) for f in far)
    assert got["a"]["avg_path"] == pytest.approx(round(sum(sum(f.values()) for f in far) / (41 * 40), 2))
    assert (got["b"]["diameter"], got["b"]["avg_path"]) == (0, 0.0)
    assert {r["site_id"]: (r["n_nodes"], r["n_edges"], r["connected"]) for r in topology.site_counts(nodes, edges).collect()} == {"a": (41, 43, True), "b": (1, 0, True)}


@pytest.mark.parametrize("cap", [0, 5, 23, 1000])
def test_byte_budget_from_coarse_to_fine(spark, cap):
    rows = [(q, at, "x" * (abs(at or 0) * 7 % 5)) for q in ("p", None) for at in (None, -450, -21, -3, 0, 1, 2, 8, 9, 27, 99, 350)] + [("one", 1, None)]
    df = spark.createDataFrame(rows, "q string, at long, t string")
    want = {}
    for q in ("p", None, "one"):
        own = sorted((r for r in rows if r[0] == q), key=lambda r: (r[1] is not None, r[1] or 0))
        sums = [sum(len(r[2] or "") for r in own[: i + 1]) for i in range(len(own))]
        want[q] = (sum(s <= cap for s in sums), sum(s > cap for s in sums))
    assert {r["q"]: (r["kept"], r["dropped"]) for r in audit.byte_budget(df, "q", "at", audit.F.col("t"), cap, width=4).collect()} == want


def test_shapes_leave_prose_out():
    assert shape_hash('{"type":"object","title":"a","items":[{"description":"b","x":1}]}') == shape_hash('{"items":[{"x":1}],"type":"object"}') != shape_hash('{"type":"object"}')
    assert shape_hash(None) == shape_hash("") == shape_hash("[1]") == shape_hash("{") == ""


def test_models_of_owned_unowned_and_unnamed_nodes(spark):
    nodes = spark.createDataFrame(
        [("s1", "SchemaComponent", "My Pool", "", "/s1"), ("s2", "SchemaComponent", "", None, "/s2"), ("p1", "Property", "--", "", "/p1"), ("p2", "Property", "b", "", "/p2"), ("p3", "Property", "c", "/m:x", "/p3"), ("/m:x", "YangPath", "", "", "")],
        "id string, kind string, label string, yang_path string, pointer string",
    )
    edges = spark.createDataFrame([("HAS_PROPERTY", "s1", "p1"), ("HAS_PROPERTY", "s2", "p1"), ("HAS_PROPERTY", "gone", "p2"), ("COMPOSED_OF", "s1", "s2"), ("COMPOSED_OF", "s1", "gone")], "kind string, a string, b string")
    assert {r["node"]: r["model"] for r in models.models_of(nodes, edges).collect()} == {
        "s1": "schema:my-pool", "s2": "schema-pointer:/s2", "p1": "schema:my-pool.property:unnamed", "p2": "property-pointer:/p2", "p3": "yang:/m:x",
    }
    got = {tuple(r) for r in models.model_edges(nodes, edges).where("kind NOT IN ('REPRESENTS_MODEL')").collect()}
    assert got == {("MODEL_HAS_PROPERTY", "schema:my-pool", "schema:my-pool.property:unnamed"), ("MODEL_AT_YANG", "yang:/m:x", "/m:x"), ("MODEL_COMPOSED_OF", "schema:my-pool", "schema-pointer:/s2")}
    empty = {r["name"]: (r["n"], r["total"], r["ratio"]) for r in models.semantic_metrics(nodes.select("id", "kind").limit(0), edges.limit(0), nodes.select("id").limit(0)).collect()}
    assert len(empty) == 19 and set(empty.values()) == {(0, 0, 0.0)}


def test_landed_rows_of_odd_items(spark):
    items = spark.createDataFrame([(1, '{"serial":"a","name":null,"site_id":5}'), (2, None), (3, "no json"), (4, "[1]"), (5, '{"serialNumber":"a","name":"new"}'), (5, '{"serial":"b"}'), (None, '{"serial":"b","name":"undated"}')], "ord int, item string")
    rows = {r["serial"]: (r["name"], r["site_id"], r["group_id"]) for r in inventory.scope_rows(items, "device", "ord").collect()}
    assert rows == {"a": ("new", "", ""), "b": ("", "", "")}  # the latest row replaces whole rows; undated ones are oldest
    assert {r["serial"]: r["site_id"] for r in inventory.scope_rows(items, "device", "ord", site="5").collect()} == {"a": "5"}
    assert inventory.client_rows(items.limit(0), "ord").count() == 0
    assert [r["id"] for r in inventory.profile_rows(spark.createDataFrame([(1, '{"name":"x"}'), (2, '{"id":""}'), (3, "{}")], "ord int, item string"), "dns", "ord").collect()] == ["dns:x"]


def test_endpoints_of_contained_segments(spark):
    known = spark.createDataFrame([("GET", "/v1/vlans-all"), ("PUT", "/v1/vlans-all"), ("GET", "/v1/ab"), ("GET", "/v1/%_x"), ("GET", None)], "method string, path string")
    asked = spark.createDataFrame([("/v2beta1/vlan/ab",), ("/v1/v1",), ("/%_x",), ("",), (None,)], "path string")
    found = sorted((r["path"], r["rank"], r["method"], r["suggestion"]) for r in discover.suggest_endpoints(asked, known).collect())
    assert found == [("/%_x", 1, "GET", "/v1/%_x"), ("/v2beta1/vlan/ab", 1, "GET", "/v1/vlans-all"), ("/v2beta1/vlan/ab", 2, "PUT", "/v1/vlans-all")]


def test_manifest_fails_with_a_gate(spark):
    gates = spark.createDataFrame([("a", True), ("b", False)], "gate string, passed boolean")
    row = sinks.manifest({"t": spark.range(3)}, "v", gates).first()
    assert (row["tables"], row["gates"], row["passed"]) == ('{"t":3}', '{"a":true,"b":false}', False)


def test_module_and_map_rows(spark):
    rows = spark.createDataFrame([("/a/m:b/n:c",), ("/x",), ("",), (None,), ("m:b",)], "yang_path string")
    assert sorted(tuple(r) for r in projection.yang_rows(rows).collect()) == [("YangModule", "m", "m"), ("YangPath", "/a/m:b/n:c", "m"), ("YangPath", "/x", ""), ("YangPath", "m:b", "m")]
    kind = "table_name string, row_id string, semantic_id string, ast_id string, spec_id string, pointer string, source string, status string"
    maps = spark.createDataFrame([("T", "r", None, "a", "s", "/p", "y", "tolerant"), ("T", "r", None, "a", "s", "/p", "x", "strict_valid"), ("T", "r", "q", "a", "s", "/p", "x", "tolerant")], kind)
    assert sorted((r["semantic_id"] or "", r["source"], r["status"]) for r in projection.projection_map(maps).collect()) == [("", "x", "strict_valid"), ("q", "x", "tolerant")]


def test_carry_through_of_unreadable_documents(spark):
    corpus = spark.createDataFrame([("p", "a", "t", json.dumps(SPEC)), ("p", "b", "t", "{"), ("q", "c", "t", None), ("r", "d", "t", '{"paths":{"/x":{"get":{"responses":{"200":{"$ref":"#/nothing"}}}}}}')], "spec_source string, source string, title string, raw string")
    rows = {r["spec_source"]: tuple(r)[1:6] for r in specs.carry_through(corpus, specs.flatten(corpus)).collect()}
    assert rows["q"] == (1, 1, 0, 0, 0) and rows["r"] == (1, 0, 0, 1, 1) and rows["p"][:2] == (2, 1)


ODD = [
    None, "", "[1]", "{", "{}", '{"paths":5,"components":7}', '{"paths":{"/x":3,"/y":{"get":4,"post":{"parameters":5,"tags":"t","responses":[],"requestBody":6,"deprecated":"yes","summary":7}}}}',
    '{"info":{"title":5},"paths":{"/z":{"get":{"parameters":[{"$ref":"#/components/parameters/P"}],"responses":{"200":{"$ref":"#/components/responses/None"}}}}},"components":{"parameters":{"P":{"name":"p","schema":{"$ref":"#/components/schemas/L"}}},"schemas":{"L":{"type":"object","required":"a","properties":{"a":{"$ref":"#/components/schemas/L"},"b":[1],"c":{"enum":"x","type":5,"minimum":true,"readOnly":0}}}}}}',
]


def odd_corpus(spark, rows=ODD):
    return spark.createDataFrame([("p", f"s{i}", "t", r) for i, r in enumerate(rows)] * 2, "spec_source string, source string, title string, raw string")


def test_whole_endpoints_of_odd_documents(spark):
    rows = {r["eid"]: r for r in details.endpoint_details(odd_corpus(spark)).collect()}
    assert set(rows) == {"POST:/y", "GET:/z"}
    y, z = rows["POST:/y"], rows["GET:/z"]
    assert (y["tags"], y["parameters"], y["request_body"], y["responses"], y["deprecated"], y["summary"], y["category"]) == ([], "[]", None, "[]", False, "", "Unknown")
    assert z["category"] == "" and z["responses"] == '[{"status":"200","description":"","schema":null}]' and z["parameters"].count('"properties"') == 14 and '"$circular_ref":true' in z["parameters"]
    # what would be too long stays as it is written
    short = {r["eid"]: r for r in details.endpoint_details(odd_corpus(spark), 200).collect()}
    assert short["GET:/z"]["parameters"] == '[{"name":"","in":"","required":false,"schema":{},"description":""}]'
    assert details.endpoint_details(odd_corpus(spark).limit(0)).count() == 0


def test_whole_properties_of_odd_documents(spark):
    corpus = odd_corpus(spark).distinct()
    rows = {r["id"]: r for r in details.property_details(specs.flatten(corpus), specs.spec_rows(corpus)).collect()}
    assert set(rows) == {f"p:schemas:L#prop:{k}" for k in "abc"}
    a, b, c = (rows[f"p:schemas:L#prop:{k}"] for k in "abc")
    assert (a["type"], a["required"], a["device_types"], a["constraints"]) == ("object", False, None, "{}") and (b["type"], b["constraints"]) == ("", "{}")
    assert (c["type"], c["enum_values"], c["minimum"], c["read_only"], c["constraints"]) == ("", [], None, False, '{"enum":"x","minimum":true,"readOnly":0}')


def test_merged_models(spark):
    rows = spark.createDataFrame([("i", 3, "late", ["b", "a"], "p3", False), ("i", 1, "", ["a", None, ""], "p1", True), ("i", 2, "first", None, "p1", None), ("j", 1, None, [], "", False)], "identity string, ord int, name string, kinds array<string>, pointer string, required boolean")
    got = {r["identity"]: r for r in details.merged_models(rows, ["name"], {"kinds": "all_kinds", "pointer": "pointers"}).collect()}
    assert (got["i"]["name"], got["i"]["all_kinds"], got["i"]["pointers"], got["i"]["required"], got["i"]["n"]) == ("first", ["a", "b"], ["p1", "p3"], True, 3)
    assert (got["j"]["name"], got["j"]["all_kinds"], got["j"]["pointers"], got["j"]["required"]) == (None, [], [], False)
    assert details.merged_models(rows.limit(0), ["name"], {"kinds": "k"}).count() == 0


def test_estimates_follow_what_is_written_not_the_table_behind_it(spark):
    from specgraph.operators.walk import shared_checkpoint

    def estimate(df):
        return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    rows = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 512).alias("a"))
    kept = shared_checkpoint(rows.withColumn("b", F.sha2(F.concat("a", F.lit("x")), 512)))
    assert estimate(kept) > 2_000_000 > estimate(rows)
    for _ in range(4):
        kept = shared_checkpoint(kept.join(kept, ["a", "b"]))
    assert estimate(kept) < 10_000_000 and kept.count() == 20_000


def test_documents_of_a_short_file_are_dealt_over_all_tasks(spark, tiny):
    from specgraph.plans.bridge import dealt, frame

    texts = frame(spark, tiny, f"SELECT CAST(k AS STRING) AS t FROM ({dealt(spark, 'SELECT p_partkey AS k FROM part')}) x")
    assert sum(1 for n in texts.groupBy(F.spark_partition_id()).count().collect()) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_documents_alone_are_not_flattened(spark, tiny, monkeypatch):
    from specgraph.plans import lineage

    monkeypatch.setattr(lineage.specs, "flatten", lambda *_: pytest.fail("flattened"))
    assert registry.QUERIES["cl_9_expanded_texts"](spark, tiny).columns == ["source", "section", "name", "body", "n_chars"]


def test_rows_of_documents_are_joined_as_written(spark, tiny):
    from specgraph.plans import specs as plans

    assert "MapInArrow" not in plans.sg_1_first_media_type(spark, tiny)._jdf.queryExecution().toString()


def test_endpoints_need_no_other_values(spark):
    corpus = spark.createDataFrame([("p", "s", "t", json.dumps(SPEC))], "spec_source string, source string, title string, raw string")
    few, every = specs.endpoint_values(corpus), specs.flatten(corpus)
    rows = specs.spec_rows(corpus)
    assert few.count() < every.count() / 4 and few.where("raw IS NOT NULL").count() == 0
    assert sorted(map(tuple, specs.endpoint_rows(few, rows).collect())) == sorted(map(tuple, specs.endpoint_rows(every, rows).collect()))


def test_documents_shuffle_lines_alone(spark, tiny):
    """What a document is made of is grouped and joined where its lines are: rows are dealt by order, once for each branch, and no half of a document is broadcast."""
    from specgraph.plans import specs as plans

    plan = plans.documents(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert moved and all("hashpartitioning(l_orderkey" in line for line in moved), moved


def test_walk_makes_what_is_asked_for():
    document = {"paths": {"/a~b": {"get": {"summary": 'é"', "tags": [1, 2.5, None, True, 10**30]}}}, "components": {"schemas": {"x-A": {"properties": {"p": {"type": "object"}}}}}}
    every = list(jsonwalk.walk(document))
    assert [r[7] for r in every if r[5] == "scalar"] == ['"é\\""', "1", "2.5", "null", "true", str(10**30), '"object"']
    some = list(jsonwalk.walk(document, False, frozenset(["Operation", "Property"]), ("kind", "value_type")))
    assert [(r[4], r[5], r[10], r[11]) for r in some] == [(r[4], r[5], r[10], r[11]) for r in every if r[4] in ("Operation", "Property")]
    assert {r[0] for r in some} == {""}


def test_projections_make_what_is_asked_for(spark):
    corpus = spark.createDataFrame([("p", "s", "t", json.dumps(SPEC)), ("p", "b", "t", "[1]")], "spec_source string, source string, title string, raw string")
    some = ["source", "method", "path", "n_components", "required"]
    every = sorted(specs.endpoint_projections(corpus).select(*some).collect())
    assert every and sorted(specs.endpoint_projections(corpus, some).collect()) == every
    assert [tuple(r) for r in specs.spec_rows(corpus, ("source", "raw")).collect()] == [("s", json.dumps(SPEC))]


def test_documents_are_made_once(spark, tiny):
    """Cleaning or normalising and flattening are one step of Python each: counts go by the rows' own source, so no document is made again to name it."""
    for name in ("cl_1_clean", "cl_6_shared_shapes"):
        plan = registry.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
        assert plan.lower().count("mapinarrow") == 2, name


def test_summaries_need_no_other_values(spark):
    """What ``sm_1_node_rows`` writes is enough: all other kinds and columns change no summary."""
    made = corpus(spark, SPEC, {"components": {"schemas": {"A": {"required": ["x"], "properties": {"x": {"type": "object", "required": ["required"], "properties": {"required": {"x-k": {"required": ["q"]}}}}}, "allOf": [{"required": ["z"], "properties": {"z": {}}}]}}}})
    few = details.node_summaries(specs.flatten(made, details.SUMMARY_KEYS, details.SUMMARY_KINDS))
    every = details.node_summaries(specs.flatten(made))
    assert sorted(map(str, few.drop("source").collect())) == sorted(map(str, every.collect())) and few.where("required").count() > 3
    assert {r["source"] for r in few.select("source").collect()} == {"s0", "s1"}


@pytest.mark.parametrize("medium", [0, 30, 10**6])
def test_path_lengths_by_groups_of_starts_and_by_rounds(spark, monkeypatch, medium):
    """Sites below and above the limit have the same lengths; no site writes a row for each node and word of starts below it."""
    monkeypatch.setattr(topology, "MEDIUM", medium)
    monkeypatch.setattr(topology, "STARTS", 7)
    rng = random.Random(5)
    sites = {"ring": [(i, (i + 1) % 30) for i in range(30)], "odd": [(rng.randint(0, 90), rng.randint(0, 90)) for _ in range(100)], "small": [(1, 2), (2, 3)]}
    nodes = {s: sorted({n for p in ps for n in p} | {200}) for s, ps in sites.items()}
    far = {s: [d for n in ns for d in distances(ns, sites[s], n).values()] for s, ns in nodes.items()}
    got = topology.path_lengths(spark.createDataFrame([(s, n) for s, ns in nodes.items() for n in ns], "site_id string, node long"), spark.createDataFrame([(s, *p) for s, ps in sites.items() for p in ps], "site_id string, u long, v long"))
    assert {r["site_id"]: (r["far"], r["steps"]) for r in got.collect()} == {s: (max(d), sum(d)) for s, d in far.items()}


def test_links_of_sites_meet_on_their_rank(spark, tiny):
    from specgraph.plans import bridge, inventory

    links = inventory._web(spark, tiny)[1]
    assert "NestedLoop" not in links._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, links.collect())) == sorted(map(tuple, bridge.frame(spark, tiny, f"WITH {inventory.RANKED} {inventory.WEB}").collect()))
    ranks = [c.strip() for c in links._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in c]
    assert ranks and all(" OR " not in c for c in ranks)


def test_searches_of_many_words():
    pairs = [(i, i + 1) for i in range(1200)]
    u, v = (topology.np.array(x) for x in zip(*pairs, strict=True))
    assert topology.searched(topology.np.arange(1201), u, v) == (1200, sum(abs(a - b) for a in range(1201) for b in range(1201)))


def test_shapes_of_documents_equal_those_of_their_rows(spark):
    """Whole documents give what the rows of all their values give, with fewer rows."""
    shape = {"type": "object", "properties": {"x": {}, "y": [1, 1.0, {"type": "object", "properties": {"c": 1, "b": {}, "a": None}}], "properties": {"type": "object", "properties": {"a": None, "b": {}, "c": 1}}}}
    turned = dict(reversed(shape.items()))
    made = corpus(spark, {"a": shape, "b": [turned, turned], "components": {"schemas": {"N": shape, "M": {"items": shape}}}}, {"x-y/z~": turned, "type": "object", "properties": {"p": 1, "q": 2, "r": 3}}, "[1]", SPEC)
    ast = specs.flatten(made)
    for least in (1, 2):
        rows, whole = projection.shared_objects(ast, least).drop("hash"), specs.shared_shapes(made, least).drop("hash")
        assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, whole.select(*rows.columns).collect())) != []


@pytest.mark.parametrize("short", [3, 64])
def test_suggested_endpoints_equal_a_search_of_all(spark, monkeypatch, short):
    """Long known segments meet on letters, others on their parts: no segment inside another is missed."""
    monkeypatch.setattr(discover, "SHORT", short)
    rng = random.Random(3)
    word = lambda k: "".join(rng.choice("ab1") for _ in range(k))
    known = sorted({(rng.choice(["GET", "PUT"]), "/" + "/".join(word(rng.randint(1, 7)) for _ in range(3))) for _ in range(120)})
    paths = sorted({"/v1/" + "/".join(word(rng.randint(2, 5)) for _ in range(4)) for _ in range(30)})
    want = set()
    for path in paths:
        segments = sorted((s for s in path.split("/") if s and s != "v1"), key=len, reverse=True)[:3]
        best = {}
        for n, s in enumerate(segments):
            hits = sorted((len(p), p, m) for m, p in known if s in p) if len(s) >= 3 else []
            for size, p, m in hits[:5]:
                best.setdefault((m, p), (n, size, p, m))
        want |= {(path, k, m, p) for k, (_, _, p, m) in enumerate(sorted(best.values())[:5], 1)}
    found = discover.suggest_endpoints(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(known, "method string, path string"))
    assert {(r["path"], r["rank"], r["method"], r["suggestion"]) for r in found.collect()} == want


def test_written_sections_are_dealt_over_all_tasks(spark, tiny):
    pages = registry.QUERIES["io_5_written_sections"](spark, tiny)
    assert pages.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_counts_of_tables_need_no_gates(spark, tiny):
    plan = registry.QUERIES["io_10_manifest"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in plan and "l_partkey" not in plan


def test_written_rows_keep_their_source(spark, tiny):
    """Rows that are read back are not joined with their documents, whole texts included."""
    assert "Join" not in registry.QUERIES["io_9_written_ast"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()


def test_views_that_are_kept_are_grouped_once(spark, tiny):
    from specgraph.plans import bridge, semantics

    kept = bridge.keep(spark, tiny, "b_component", "b_property")
    nodes, plain = bridge.frame(spark, tiny, semantics.EDGES, kept), bridge.frame(spark, tiny, semantics.EDGES)
    assert "l_partkey" not in nodes._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(str, nodes.collect())) == sorted(map(str, plain.collect()))


def test_map_ids_are_made_after_rows_have_met(spark, tiny):
    plan = registry.QUERIES["ag_7_projection_map"](spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert all("projection_id" not in line and "sha1" not in line for line in plan.split("Aggregate [", 1)[1].splitlines()[1:])


def test_hits_are_not_joined_on_their_term_again(spark, tmp_path):
    rows = spark.createDataFrame([(1, "the cat the"), (2, "the dog"), (3, None)], "doc_id long, text string")
    index = search.write_index(rows, "doc_id", {"text": F.col("text")}, str(tmp_path / "index"))
    found = index.prefix(spark.createDataFrame([("q", "t"), ("r", "c"), ("s", "")], "query string, text string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2  # the postings with weighed terms, and the one row of totals
    assert {(r["query"], r["doc"]) for r in found.collect()} == {("q", 1), ("q", 2), ("r", 1)}


def _plain_words(text):
    return re.findall("[a-z0-9_]+", (text or "").lower())


ODD_TEXTS = ["the cat of the", "The_Cat of\nthe dog; of the", None, "", "éa bé Kelvin İx", "of", "the", "of the of the", "日本 of the 7_x", " ,", "the of"]


def test_index_has_a_row_for_a_word_of_many_documents(spark, tmp_path):
    texts = ODD_TEXTS * 9
    rows = spark.createDataFrame([(i, t, "of the web") for i, t in enumerate(texts)], "doc_id long, text string, source string").coalesce(1)
    index = search.write_index(rows, "doc_id", {"text": F.col("text"), "source": F.col("source")}, str(tmp_path / "index"))
    assert index.postings.where("term = 'the' AND field = 'text'").count() == 1  # not one for each document
    words = [(_plain_words(t), ["of", "the", "web"]) for t in texts]
    assert {r["term"]: r["df"] for r in index.terms.collect()} == Counter(t for a, b in words for t in {*a, *b})
    assert index.totals.collect()[0][:] == (len(texts), sum(len(a) + len(b) for a, b in words) / len(texts))
    found = {}
    for r in search.opened(index.postings, "field", "term").collect():
        found[r["doc"], r["field"], r["term"]] = (r["tf"], r["dl"])
    assert found == {(i, f, t): (n, len(w[0]) + len(w[1])) for i, w in enumerate(words) for f, own in zip(("text", "source"), w, strict=True) for t, n in Counter(own).items()}
    hits = index.phrase(spark.createDataFrame([("q", "of the"), ("r", "the of the"), ("s", "of web")], "query string, text string"), ["text"]).collect()
    assert {(r["query"], r["doc"]) for r in hits} == {(q, i) for i, (w, _) in enumerate(words) for q, p in (("q", " of the "), ("r", " the of the ")) if p in f" {' '.join(w)} "}


def test_texts_are_split_by_chunks(monkeypatch):
    monkeypatch.setattr(search, "CHUNK", 16)
    texts = pa.array([(t or "").lower() for t in ODD_TEXTS])
    row, found = search._words(texts.slice(1, 9))
    assert list(zip(row.tolist(), found.to_pylist(), strict=True)) == [(i, w) for i, t in enumerate(ODD_TEXTS[1:10]) for w in _plain_words(t)]
    field, term, docs, dl, ends, n_docs, places = (c.to_pylist() for c in search._block(pa.array(range(10)), {"a": texts.slice(0, 10), "b": texts.slice(1, 10)}, True))
    assert (field[-1], term[-1], docs[-1], n_docs[-1]) == (None, None, [], 10)
    for f, t, d, e, p in zip(field[:-1], term[:-1], docs[:-1], ends[:-1], places[:-1], strict=True):
        own = [_plain_words(x) for x in (ODD_TEXTS[0:10] if f == "a" else ODD_TEXTS[1:11])]
        assert d == [i for i, w in enumerate(own) if t in w]
        assert [p[lo:hi] for lo, hi in zip([0, *e], e, strict=False)] == [[k for k, w in enumerate(own[i]) if w == t] for i in d]


def test_bm25_splits_texts_once(spark):
    rows = spark.createDataFrame(list(enumerate(ODD_TEXTS)), "id long, text string")
    asked = [("q", "the"), ("q", "of"), ("r", "cat"), ("r", "none"), ("q", "the")]
    scored = search.bm25(rows, "id", F.col("text"), spark.createDataFrame(asked, "query string, term string"))
    assert "split(" not in scored._jdf.queryExecution().optimizedPlan().toString()
    words = [_plain_words(t) for t in ODD_TEXTS]
    mean, want = sum(map(len, words)) / len(words), {}
    for q, t in sorted(set(asked)):
        df = sum(t in w for w in words)
        for i, w in enumerate(words):
            if t in w:
                part = math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean))
                want[q, i] = want.get((q, i), 0) + part
    assert {(r["query"], r["doc"]): round(r["score"], 9) for r in scored.collect()} == {k: round(v, 9) for k, v in want.items()}


def test_outcomes_are_those_of_the_librarys_reader(spark):
    texts = ['{"a":1}', '{"a":1} x', "{'a':1}", '{"a":NaN}', '{"a":1,"a":2}', '{"a":"\t"}', '{"a":01}', '{"a":1}]', '{"a":1},{"h":2}', '{"a":1}],[{"b":1}', '{"h":"x"}', ' {"a":1}', '{"a":1}\n', '{"a":1}\x0b', "{a:1}", '{"a":/*c*/1}', '{"a":"\\q"}']
    texts += ['{"a":1,}', '{"a":"\\ud800"}', '{"a":1e999}', '{"a":Infinity}', '{"a":' * 1200 + "1" + "}" * 1200, '{"a":' * 6000 + "1" + "}" * 6000, '{"a":' + "1" * 2000 + "}", "[]", "5", "", None, "{}"]
    corpus = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "spec_source string, raw string")
    assert {int(r["spec_source"]): r["status"] for r in specs.outcomes(corpus).collect()} == {i: jsonwalk.parsed(t)[1] for i, t in enumerate(texts)}
    sure = {int(r["spec_source"]) for r in corpus.where(specs._surely_ok(F.col("raw"))).collect()}
    assert {0, len(texts) - 1} <= sure <= {i for i, t in enumerate(texts) if jsonwalk.parsed(t)[1] == "ok"}


def test_documents_of_odd_lines_group_no_texts(spark, tmp_path):
    from specgraph.plans import specs as plans

    lines = [(1, 1, 7, 3, 30.0, 'a"b\n'), (1, 2, 7, 4, 10.0, "N"), (1, 3, None, 3, 5.0, "A"), (2, 1, 5, None, None, None), (None, 1, 5, 2, 1.0, "R"), (3, None, 5, 2, 40.0, "R")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    made = plans.documents(spark, str(tmp_path), rich=True)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    found = {int(r["source"]): json.loads(r["raw"]) for r in made.collect()}
    assert set(found) == {1, 2, 3}
    assert set(found[1]["paths"]) == {"/parts/7/lines/1", "/parts/7/lines/2"} and set(found[1]["components"]["schemas"]) == {"P7", "S4", "S3"}
    assert found[1]["paths"]["/parts/7/lines/1"]["put"]["summary"] == 'flag a"b\n' and found[1]["components"]["schemas"]["P7"]["properties"]["sup"] == {"$ref": "#/components/schemas/Gone4"}
    operation = found[2]["paths"]["/parts/5/lines/1"]["get"]
    assert "summary" not in operation and "deprecated" not in operation and "required" not in operation["parameters"][1]
    assert found[2]["components"]["schemas"] == {"P5": {"type": "object", "_id": 1, "properties": {"qty": {"type": "integer", "format": "const", "x-path": "/m1:top/qty"}, "sup": {}, "all": {"type": "array", "items": {}}, "dim": {"type": "object", "properties": {"h": {"type": "integer", "minimum": 1}}}}}}
    assert found[3]["paths"] == {} and found[3]["components"]["schemas"]["P5"]["allOf"] == [{"$ref": "#/components/schemas/S2"}]


def test_longest_wins_leaves_no_tie_open(spark):
    """Of rows of one place the least body wins, whatever the order and the partitions; a null body or place never wins over another one."""
    rows = [("p", "s", "N", "body 2", 7), ("p", "s", "N", "body 1", 7), ("p", "s", "N", None, 1), ("p", "s", "M", "aa", None), ("p", "s", "M", "bb", 9), ("p", "s", "O", None, 3)]
    for order in (rows, rows[::-1]):
        for n in (1, 5):
            df = spark.createDataFrame(order, "provider string, section string, name string, body string, ord int").repartition(n)
            assert {r["name"]: (r["body"], r["ord"]) for r in merge.longest_wins(df, ["provider", "section", "name"]).collect()} == {"N": ("body 1", 7), "M": ("bb", 9), "O": (None, 3)}


#: Documents whose references have odd spellings, values and places.
TANGLED = [
    *ODD, '{"$ref":"#","a":[{"$ref":"#/a/0"},{"$ref":"#/a/00"},{"$ref":"#/a/9"},{"$ref":"#/a/\u00b2"},{"$ref":5},{"$ref":null},{"$ref":true},{"$ref":["#/a"]},{"$ref":{"$ref":"other.json#/x"}}],"x~y/z":{"$ref":"#/x~0y~1z"},"b":{"$ref":"#/x~y/z"},"c":{"$ref":"#a"}}',
    '{"paths":{"/a":{"get":{"x-q":{"tags":{"k":1}},"tags":["t"],"callbacks":{"cb":{"u":{"post":{"summary":1}}}},"parameters":[{"schema":{"$ref":"#/components/schemas/A~1B"}}]}}},"tags":[{"name":"n","q":1}],"components":{"schemas":{"A/B":{"properties":{"p":{"$ref":"#/components/schemas/N"},"all":{"items":{"$ref":"#/components/schemas/A~1B/properties/p"}}},"allOf":[{"$ref":"#/components/schemas/A~1B"}],"required":["p"],"discriminator":{"m":{"k":1}}},"x-S":7,"L":[{"$ref":"#/components/schemas/L/0"}]},"x-more":{"k":{"$ref":"#/components/x-more"}}}}',
]


def tangled_corpus(spark):
    """Each document once, under its own source."""
    return spark.createDataFrame([(f"p{i % 2}", f"s{i:02}", f"t{i}", r) for i, r in enumerate([*TANGLED, json.dumps(SPEC)])], "spec_source string, source string, title string, raw string")


def sorted_rows(df, *columns):
    return sorted(map(str, df.select(*(columns or df.columns)).collect()))


def test_references_found_in_documents_equal_those_of_rows(spark):
    made = tangled_corpus(spark)
    ast, rows = specs.flatten(made), specs.spec_rows(made)
    want = specs.references(ast).join(rows, "spec_id").withColumn("found", F.col("target").isNotNull())
    got = specs.reference_rows(made)
    assert sorted_rows(got, "source", "pointer", "ref", "found") == sorted_rows(want, "source", "pointer", "ref", "found") and got.count() > 15
    assert "Join" not in got._jdf.queryExecution().toString()
    counted = want.groupBy("source", "ref", "found").agg(F.count("*").alias("n"))
    assert sorted_rows(specs.reference_links(made), "source", "ref", "found", "n") == sorted_rows(counted, "source", "ref", "found", "n")


def test_edges_of_references_need_no_rows_of_values(spark):
    made = tangled_corpus(spark)
    ast, rows = specs.flatten(made), specs.spec_rows(made)
    refs = specs.reference_rows(made, "/components/schemas")
    assert sorted_rows(specs.edges_of_references(refs)) == sorted_rows(specs.reference_edges(ast, rows)) != []
    assert sorted_rows(projection.type_edges_of(refs)) == sorted_rows(projection.type_edges(ast, rows)) != []


def test_outcomes_of_checks_are_counted_in_documents(spark):
    made = tangled_corpus(spark)
    allowed = spark.createDataFrame([("Document", "paths"), ("Document", "a"), ("Operation", "tags"), ("Scalar", "p"), ("Schema", "required"), ("Tag", "name")], "kind string, key string")
    want = specs.check_outcomes(specs.flatten(made), allowed).join(specs.spec_rows(made), "spec_id")
    columns = ("source", "n_unknown", "n_unresolved", "n_external", "degraded")
    assert sorted_rows(specs.checked(made, allowed), *columns) == sorted_rows(want, *columns)
    counts = {r["source"]: r["n_found"] + r["n_lost"] for r in specs.reference_counts(made).collect()}
    assert counts == {r["source"]: r["n"] for r in specs.spec_rows(made).join(specs.references(specs.flatten(made)), "spec_id", "left").groupBy("source").agg(F.count("ref").alias("n")).collect()}


def test_only_wanted_keys_are_rows(spark):
    made = tangled_corpus(spark)
    few = specs.flatten(made, ("source", "pointer", "key"), keys=lambda k: k == "tags")
    assert sorted_rows(few) == sorted_rows(specs.flatten(made, ("source", "pointer", "key")).where("key = 'tags' OR pointer = ''"))
    shut = specs.flatten(made, ("spec_source", "pointer"), closed=("PathItem",), deepest=3)
    assert sorted_rows(shut) == sorted_rows(specs.flatten(made, ("spec_source", "pointer", "depth")).where("depth <= 3 AND NOT pointer LIKE '/paths/%/%'"), "spec_source", "pointer")


def test_first_operations_equal_those_of_rows(spark):
    made = tangled_corpus(spark)
    rows = specs.spec_rows(made)
    want = specs.endpoint_rows(specs.flatten(made), rows).drop("spec_id")
    got = specs.first_operations(specs.operation_values(made))
    assert sorted_rows(got, *want.columns) == sorted_rows(want) and got.count() > 4


#: Parts of operations in place, of the path, behind references of the document, of another document of the provider and to nothing, and of odd shapes.
PARTED = [
    '{"paths":{"/a":{"parameters":[{"name":"q","in":"query"},{"name":"r","in":"query"},3],"get":{"x-cliParam":{"commandName":"c","paramKeys":["a",{"key":"b"}]},"parameters":[{"name":"q","in":"query","required":true,"schema":{"type":"string","enum":["e",1]}},{"$ref":"#/components/parameters/P"},{"$ref":"#/components/parameters/Gone"},{"$ref":"other.json"},{"name":"q","in":"query","description":"last"},{"$ref":"#/x-odd"},{"$ref":"#/info"}],'
    '"requestBody":{"$ref":"#/components/requestBodies/B"},"responses":{"200":{"content":{"b/b":{"schema":{"$ref":"#/components/schemas/A"}},"application/json":{"schema":{"$ref":"#/components/schemas/J"}}}},"4~/":{"$ref":"#/components/responses/R"},"500":{},"x-r":{"content":{"a/a":5}},"no":4}},'
    '"post":{"responses":[{"content":{}}],"x-cliParam":5,"callbacks":{"cb":{"u":{"put":{"parameters":[{"name":"z"}],"responses":{"200":{}}}}}}}}},"info":{"name":"i","in":"query"},"x-odd":{"name":"o","in":"path"},"components":{"parameters":{"P":{"name":"p","in":"path"}},"responses":{"R":{"content":{"a/a":{}}}}}}',
    '{"paths":{"/b":{"delete":{"parameters":[{"$ref":"#/components/parameters/P"}],"requestBody":{"required":true,"content":{"a/a":{"schema":{"type":"object"}}}},"responses":{"200":{"$ref":"#/components/responses/R"}}}}},"components":{"parameters":{"P":{"name":"p","in":"path","description":"a longer one"},"Gone":{"name":"g","in":"query"}},"requestBodies":{"B":{"required":true,"content":{"c/c":{"schema":{"$ref":"#/components/schemas/C"}}}}}}}',
]


def test_parts_of_operations_equal_those_of_rows(spark):
    texts = [*PARTED, PARTED[0].replace('"/a"', '"/c"'), *TANGLED, json.dumps(SPEC)]
    made = spark.createDataFrame([(f"p{i % 3 // 2}", f"s{i:02}", "t", r) for i, r in enumerate(texts)], "spec_source string, source string, title string, raw string")
    ast, rows = specs.flatten(made), specs.spec_rows(made)
    ends = specs.endpoint_rows(ast, rows)
    want = operation_parts.parameter_rows(ast, rows, ends)
    assert sorted_rows(operation_parts.parameters_of(operation_parts.operation_parts(made, "parameters")), *want.columns) == sorted_rows(want) and want.count() > 8
    want = operation_parts.media_rows(ast, rows, ends)
    assert sorted_rows(operation_parts.media_of(operation_parts.operation_parts(made, "media")), *want.columns) == sorted_rows(want) and want.count() > 8
    want = projection.cli_rows(ast, ends)
    assert sorted_rows(projection.commands(specs.first_operations(specs.operation_values(made, "cli")))) == sorted_rows(want) and want.count() > 1


def test_operations_alone_are_visited():
    visited = {r[4] for r in jsonwalk.walk(json.loads(PARTED[0]), False, None, ("pointer",), specs.NO_OPERATIONS)}
    assert "Operation" in visited and not visited & {"Schema", "MediaType", "Constraint"}


@pytest.mark.parametrize("links", [walk.LINKS, 0])
def test_searches_equal_walks(spark, monkeypatch, links):
    """Counts and values of graphs with circles, joints and loose nodes, by groups of searches and by rounds; 1,300 labels are more than are searched at once, some with two starts."""
    monkeypatch.setattr(walk, "LINKS", links)
    draw = random.Random(4)
    pairs = [(f"n{draw.randrange(60)}", f"n{draw.randrange(60)}") for _ in range(90)] + [("n0", "n1"), ("n1", "n0"), ("lone", "lone")]
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)

    def reached(start):
        seen, todo = set(), [start]
        while todo:
            if (node := todo.pop()) not in seen:
                seen.add(node)
                todo += near.get(node, ())
        return seen

    edges = spark.createDataFrame(pairs, "a string, b string")
    names = [f"n{i}" for i in range(60)] + ["lone", "nowhere"]
    roots = spark.createDataFrame([(n,) for n in names], "root string")
    assert {r["root"]: r["n_reached"] for r in walk.reached_counts(roots, edges).collect()} == {n: len(reached(n)) for n in names}
    held = [(f"n{i}", f"v{i % 7}") for i in range(0, 60, 3)] + [("nowhere", "v0"), ("nowhere", "w")]
    count = 1300 if links else 60
    starts = [(f"e{i}", names[i * 7 % len(names)]) for i in range(count)] + [(f"e{i}", names[i * 5 % len(names)]) for i in range(0, count, 3)]
    want = {(e, v) for e, n in starts for m, v in held if m in reached(n)}
    rows = [tuple(r) for r in walk.labelled_values(spark.createDataFrame(starts, "label string, node string"), edges, spark.createDataFrame(held, "node string, value string")).collect()]
    assert len(rows) == len(want) and set(rows) == want


def test_schemas_of_documents_equal_those_of_rows(spark):
    made = tangled_corpus(spark)
    ast, rows = specs.flatten(made), specs.spec_rows(made)
    want = specs.component_rows(ast, rows)
    assert sorted_rows(specs.components_of(specs.named_schemas(made), specs.unnamed_references(made)), *want.columns) == sorted_rows(want) and want.where("kind = 'unresolved'").count() > 1
    want = specs.property_rows(ast, rows).drop("spec_id")
    assert sorted_rows(specs.property_columns(specs.named_properties(made)), *want.columns) == sorted_rows(want) and want.where("required").count() > 0
    want = projection.inline_components(ast, rows).drop("spec_id")
    assert sorted_rows(projection.inline_of(projection.inline_values(made)), *want.columns) == sorted_rows(want) and want.count() > 0
    parted = made.unionByName(spark.createDataFrame([("q", f"q{i}", "t", r) for i, r in enumerate([*PARTED, '{"components":{"x-a":{"k":1},"y":[2,3],"schemas":{"parameters":{}}}}'])], made.schema))
    want = projection.reusable_parts(specs.flatten(parted), specs.spec_rows(parted))
    assert sorted_rows(projection.parts_of(specs.flatten(parted, ("spec_source", "pointer", "key", "depth"), closed=("PathItem", "Schema"), deepest=3))) == sorted_rows(want) and want.count() > 5


def test_overlay_of_documents_equals_that_of_rows(spark):
    made = spark.createDataFrame([(f"p{i % 2}", f"s{i:02}", "t", r) for i, r in enumerate([*PARTED, *TANGLED, json.dumps(SPEC), '{"components":{"responses":{"R":{"content":{"a/b":{}}}}}}', '{"content":{"a":{}}}'])], "spec_source string, source string, title string, raw string")
    ast = specs.flatten(made)
    want = specs.semantic_nodes(ast)
    assert sorted_rows(specs.overlay_rows(made), *want.columns) == sorted_rows(want) and want.count() > 20
    want = specs.carry_through(made, ast)
    assert sorted_rows(specs.carried(made)) == sorted_rows(want) and {r["n_failed"] > 0 for r in want.collect()} == {True}


def test_rows_in_order_make_documents_again(spark):
    texts = ['{"":{"":[[],{},"a\\\\\\"b",""]},"n":[null,true,false,1.5,-3,1e22,"null"],"é":"ü"}', "{}", *(json.dumps(json.loads(t)) for t in TANGLED[-2:]), "[1]", "{"]
    made = spark.createDataFrame([("p", f"s{i}", "t", t) for i, t in enumerate(texts * 3)], "spec_source string, source string, title string, raw string").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = specs.rebuilt_in_order(specs.flatten(made, ("source", "key", "value_type", "scalar", "depth"))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["source"]: r["raw"] for r in got} == {f"s{i}": jsonwalk.compact(json.loads(t)) for i, t in enumerate(texts * 3) if t[0] == "{" and t != "{"}


def test_normalising_again_changes_nothing_and_odd_responses_break_nothing(spark):
    made = tangled_corpus(spark).unionByName(spark.createDataFrame([("q", f"q{i}", "t", t) for i, t in enumerate(PARTED)], "spec_source string, source string, title string, raw string"))
    once = specs.normalised(made)
    want = specs.spec_rows(once).join(specs.spec_rows(specs.normalised(once)).select("source", F.col("content_hash").alias("again")), "source").select("spec_source", "source", (F.col("content_hash") == F.col("again")).alias("same"))
    assert sorted_rows(specs.settled(made)) == sorted_rows(want) and want.count() > 6
    document = json.loads(PARTED[0])
    before = json.dumps(document)
    assert jsonwalk.shared(document) == jsonwalk.shared(json.loads(before), copy=False) and json.dumps(document) == before


def test_unique_keys_meet_as_numbers(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType())])
    rows = spark.createDataFrame([(f"k{i}",) for i in range(500)], "id string")
    sinks.write_table(rows, str(tmp_path / "once"), schema, "id")
    for n in (1, 300):
        with pytest.raises(sinks.DuplicateKeyError):
            sinks.write_table(rows.unionByName(rows.limit(n)), str(tmp_path / f"twice{n}"), schema, "id")


def test_landed_files_are_dealt_over_all_tasks(spark, tiny):
    from specgraph.plans import landing

    seen = landing.landed(spark, tiny)
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(seen).select(F.regexp_extract("path", "part-([0-9]+)", 1).alias("task"))
    assert parts.distinct().count() > 1 and parts.count() == spark.read.parquet(f"{tiny}/supplier.parquet").count()


def test_pairs_are_searched_in_connected_sites_alone(spark, monkeypatch):
    monkeypatch.setattr(topology, "SMALL", 0)
    asked, lengths = [], topology.path_lengths
    monkeypatch.setattr(topology, "path_lengths", lambda nodes, pairs: asked.extend(r["site_id"] for r in nodes.select("site_id").distinct().collect()) or lengths(nodes, pairs))
    nodes = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 2), ("b", 3), ("c", 1)], "site_id string, node long")
    edges = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 1, 2)], "site_id string, u long, v long")
    rows = {r["site_id"]: tuple(r)[1:] for r in topology.site_metrics(nodes, edges).collect()}
    assert sorted(asked) == ["a", "c"]
    assert rows == {"a": (3, 2, 1, True, 2, 1.33, "1-2,2-3", "2"), "b": (3, 1, 2, False, None, None, "1-2", ""), "c": (1, 0, 1, True, 0, 0.0, "", "")}


def test_provenance_writes_no_other_values(spark, tiny):
    """Only rows that overlay nodes stand for are written and meet nodes."""
    from specgraph.plans import details as plans

    asked = []
    flat = plans.specs.flatten
    plans.specs.flatten = lambda corpus, *more, **kw: asked.append(more) or flat(corpus, *more, **kw)
    try:
        assert plans.sm_7_provenance_edges(spark, tiny).count() == plans.sm_1_node_rows(spark, tiny).count() > 0
    finally:
        plans.specs.flatten = flat
    assert asked == [(details.SUMMARY_KEYS, details.SUMMARY_KINDS)] * 2


def test_rows_at_one_place_go_by_the_tables_order(spark, tmp_path):
    """Two lines of one order, number, part and provider: the first in the file wins, whatever its body."""
    from specgraph.plans import audits

    line = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    for k, flags in enumerate(("RA", "AR")):
        spark.createDataFrame([(5, 7, 3 * i, 1, 2.0, f, "O") for i, f in enumerate(flags)], line).coalesce(1).write.parquet(f"{tmp_path}/{k}/lineitem.parquet")
        assert [r["body"][25] for r in audits.ag_2_pool(spark, f"{tmp_path}/{k}").collect()] == [flags[0]]


def test_lineage_writes_schemas_and_documents_alone(spark, tiny, monkeypatch):
    """What is written first has no scalar, no list and no operation, and rows that have their id are not written again."""
    from specgraph.operators import lineage
    from specgraph.plans import lineage as plans

    written, keep = [], walk.shared_checkpoint
    for module in (lineage, plans):
        monkeypatch.setattr(module, "shared_checkpoint", lambda df: written.append(keep(df)) or written[-1])
    rows = plans.pj_2_lineage_ids(spark, tiny).count()
    _, values, first, *rounds = written
    assert values.where("value_type <> 'object' OR kind = 'Operation'").isEmpty() and first.count() == rows
    assert rounds and rounds[0].count() == first.where("id IS NULL").count() < rows
