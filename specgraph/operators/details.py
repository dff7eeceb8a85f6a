"""Whole rows: properties with everything that is said of them, operations with all parts expanded, merged models, summaries and provenance of overlay nodes."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgraph.functions import jsonwalk, views
from specgraph.functions.expand import Expansion
from specgraph.operators.lineage import lineage_ids, property_role, without_last
from specgraph.operators.projection import CONSTRAINTS, at
from specgraph.operators.specs import MOST_TEXT, parsed, semantic_id, text_of
from specgraph.operators.walk import shared_checkpoint

# Methods that make an endpoint row, and the title of a document without one.
ENDPOINTS = ("get", "post", "put", "patch", "delete", "head", "options")
UNTITLED = "Unknown"
#: Extensions that have columns of their own.
DEVICES, MODEL_PATH = "x-supportedDeviceType", "x-path"
_NUMBERS = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def member_map(raw: Column) -> Column:
    """The members of a JSON object by name; none for anything else."""
    return F.coalesce(F.try_parse_json(F.coalesce(raw, F.lit("{}"))).try_cast("map<string,variant>"), F.try_parse_json(F.lit("{}")).cast("map<string,variant>"))


def sorted_json(members: Column) -> Column:
    """Members as compact JSON with sorted keys at every level; ``{}`` if there is none."""
    keys = F.array_sort(F.map_keys(members))
    # most values have no such members, and a JSON writer for each is the costly part
    return F.when(F.size(members) > 0, F.to_json(F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(members, k))))).otherwise("{}")


def text_value(value: Column) -> Column:
    """The text of a JSON string, null for anything else."""
    return F.when(F.schema_of_variant(value) == "STRING", value.try_cast("string"))


def number_value(value: Column, kind: str) -> Column:
    """A JSON number (a whole one for ``long``), null for anything else: booleans and texts are not numbers."""
    whole = F.schema_of_variant(value) == "BIGINT" if kind == "long" else F.schema_of_variant(value).rlike(_NUMBERS)
    return F.when(whole, value.try_cast(kind))


def texts_of(value: Column) -> Column:
    """The texts of a JSON list; a text alone is a list of one; null for anything else."""
    return F.when(F.schema_of_variant(value) == "STRING", F.array(value.try_cast("string"))).when(
        F.schema_of_variant(value).startswith("ARRAY"), F.array_compact(F.transform(value.try_cast("array<variant>"), text_value))
    )


def plain_values(value: Column) -> Column:
    """Texts, numbers and truth values (``True``, ``False``) of a JSON list as texts; other members are left out."""

    def one(v: Column) -> Column:
        kind = F.schema_of_variant(v)
        return F.when(kind == "BOOLEAN", F.initcap(v.try_cast("string"))).when((kind == "STRING") | kind.rlike(_NUMBERS), v.try_cast("string"))

    return F.coalesce(F.array_compact(F.transform(value.try_cast("array<variant>"), one)), F.array().cast("array<string>"))


def winning_roots(ast: DataFrame, wanted: DataFrame) -> DataFrame:
    """(spec_id, root): of each (provider, root) the document whose value there is longest; of equally long ones the first by source.

    Equal texts are merged before the shuffle, so a root that nearly all documents have costs a row for each different text.
    """
    bodies = ast.where(F.col("value_type") == "object").select("spec_id", F.col("pointer").alias("root"), F.length("raw").alias("size"), F.sha1("raw").alias("hash"))
    merged = bodies.join(wanted, ["spec_id", "root"]).groupBy("provider", "root", "size", "hash").agg(F.min(F.struct("source", "spec_id")).alias("first"))
    return merged.groupBy("provider", "root").agg(F.min_by("first.spec_id", F.struct(-F.col("size"), F.col("first.source"))).alias("spec_id")).select("spec_id", "root")


def with_target(rows: DataFrame, ast: DataFrame) -> DataFrame:
    """``rows`` (spec_id, provider, source, raw, ...) with ``target``: the text of what each refers to in its document, else in the provider's longest definition, else null. One step is followed."""
    rows = rows.withColumn("wanted", F.when(at("raw", "$ref").startswith("#/"), F.expr("substring(get_json_object(raw, \"$['$ref']\"), 2)")))
    asked = rows.where("wanted IS NOT NULL").select("spec_id", "provider", "wanted").distinct()
    objects = ast.where(F.col("value_type") == "object")
    local = shared_checkpoint(asked.join(objects.select("spec_id", F.col("pointer").alias("wanted"), F.col("raw").alias("target")), ["spec_id", "wanted"], "left"))
    missing = local.where("target IS NULL").drop("target")
    # only what some document lacks is looked for among the provider's definitions
    others = objects.where(F.col("pointer").rlike("^/components/[^/]+/[^/]+$")).select("spec_id", F.col("pointer").alias("wanted"), "raw").join(rows.select("spec_id", "provider", "source").distinct(), "spec_id")
    merged = others.join(missing.select("provider", "wanted").distinct(), ["provider", "wanted"], "left_semi").groupBy("provider", "wanted", "raw").agg(F.min("source").alias("source"))
    pool = merged.groupBy("provider", "wanted").agg(F.min_by("raw", F.struct(-F.length("raw"), F.col("source"))).alias("target"))
    found = local.where("target IS NOT NULL").select("spec_id", "wanted", "target").unionByName(missing.join(pool, ["provider", "wanted"]).select("spec_id", "wanted", "target"))
    return rows.join(found, ["spec_id", "wanted"], "left").drop("wanted")


def property_details(ast: DataFrame, specs: DataFrame) -> DataFrame:
    """Every property of every schema that has an id, named or inline: (id, component_id, name, type, format, required, enum_values, description, device_types,
    yang_path, extensions, read_only, pattern, default_value, minimum, maximum, min_length, max_length, enum_descriptions, constraints, spec_id, pointer).

    A component and all below it come from one document of the provider (``winning_roots``). A property that refers takes type, format, enum, description
    and an unset read-only mark from what it names; extensions of both are one JSON text, its own first. ``device_types`` is null where nothing limits them.
    Constraints are the property's own, as a JSON text and as typed columns. A type that is a list is its JSON text; a property that is no object has no values.
    """
    documents = specs.select("spec_id", F.col("spec_source").alias("provider"), "source")
    value = F.when(F.col("value_type") == "object", F.col("raw")).otherwise("{}")
    own = ast.where(F.col("parent").endswith("/properties") & F.col("key").isNotNull()).select("spec_id", "pointer", F.col("key").alias("name"), value.alias("raw"), without_last(F.col("parent"), 1).alias("holder"))
    ids = lineage_ids(ast, specs).where("id <> ''").select("spec_id", F.col("pointer").alias("holder"), F.col("id").alias("component_id"))
    component = F.regexp_extract("holder", "^/components/[^/]+/[^/]+", 0)
    own = own.join(ids, ["spec_id", "holder"]).join(documents, "spec_id").withColumn("root", F.when(component == "", F.col("holder")).otherwise(component))
    own = own.join(winning_roots(ast, own.select("spec_id", "provider", "source", "root").distinct()), ["spec_id", "root"], "left_semi")
    needs = ast.where(F.col("idx").isNotNull() & F.col("parent").endswith("/required") & F.col("scalar").startswith('"'))
    needs = needs.select("spec_id", without_last(F.col("parent"), 1).alias("holder"), text_of(F.col("scalar")).alias("name"), F.lit(True).alias("required")).distinct()
    rows = with_target(own, ast).join(needs, ["spec_id", "holder", "name"], "left")
    rows = rows.withColumn("mine", member_map(F.col("raw"))).withColumn("theirs", member_map(F.col("target"))).withColumn("body", F.when(F.col("target").isNull(), F.col("mine")).otherwise(F.col("theirs")))
    more = F.map_filter("theirs", lambda k, _: k.startswith("x-") & ~F.map_contains_key("mine", k))
    rows = rows.withColumn("extra", F.map_concat(F.map_filter("mine", lambda k, _: k.startswith("x-")), more)).withColumn("bag", F.map_filter("mine", lambda k, _: k.isin(*CONSTRAINTS)))

    def text(name: str, *maps: str) -> Column:
        return F.coalesce(*(F.when(F.length(t) > 0, t) for t in (text_value(F.col(m)[name]) for m in maps)), F.lit(""))

    def json_of(name: str) -> Column:
        return F.coalesce(F.to_json(F.col("bag")[name]), F.lit(""))

    marked = F.coalesce(F.col("mine")["readOnly"], F.col("body")["readOnly"])
    kind = F.col("body")["type"]
    return rows.select(
        F.concat("component_id", F.lit("#prop:"), "name").alias("id"), "component_id", "name", F.coalesce(text_value(kind), F.when(F.schema_of_variant(kind).startswith("ARRAY"), F.to_json(kind)), F.lit("")).alias("type"), text("format", "body").alias("format"),
        F.coalesce("required", F.lit(False)).alias("required"), plain_values(F.col("body")["enum"]).alias("enum_values"), text("description", "body", "mine").alias("description"), texts_of(F.col("extra")[DEVICES]).alias("device_types"),
        text(MODEL_PATH, "extra").alias("yang_path"), F.when(F.size("extra") > 0, sorted_json(F.col("extra"))).otherwise("").alias("extensions"), F.coalesce((F.schema_of_variant(marked) == "BOOLEAN") & marked.try_cast("boolean"), F.lit(False)).alias("read_only"),
        text("pattern", "bag").alias("pattern"), json_of("default").alias("default_value"), *(number_value(F.col("bag")[k], "double").alias(k) for k in ("minimum", "maximum")),
        number_value(F.col("bag")["minLength"], "long").alias("min_length"), number_value(F.col("bag")["maxLength"], "long").alias("max_length"), json_of("x-enumDescriptions").alias("enum_descriptions"), sorted_json(F.col("bag")).alias("constraints"),
        "spec_id", "pointer",
    )


_DETAILS = "source string, ord int, eid string, method string, path string, category string, operation_id string, summary string, description string, tags array<string>, deprecated boolean, parameters string, request_body string, responses string"


def _text(value: object) -> str:
    return value if isinstance(value, str) else ""


def _operation(op: dict, expanded) -> tuple:  # noqa: ANN001
    """(operation id, summary, description, tags, deprecated, parameters, request body, responses) of an operation, parts as JSON texts."""
    given = op.get("parameters")
    asked = [views.as_object(expanded(p)) for p in (given if isinstance(given, list) else [])]
    parameters = [{"name": p.get("name", ""), "in": p.get("in", ""), "required": p.get("required", False), "schema": p.get("schema", {}), "description": p.get("description", "")} for p in asked]
    content = views.as_object(views.as_object(expanded(op.get("requestBody"))).get("content"))
    body = None
    if content:
        name = next((m for m in views.MEDIA if m in content), next(iter(content)))
        body = views.as_object(content[name]).get("schema", {})
    responses = []
    for status, answer in views.as_object(op.get("responses")).items():
        answer = views.as_object(expanded(answer))
        media = views.as_object(answer.get("content")).get(views.MEDIA[0])
        responses.append({"status": status, "description": answer.get("description", ""), "schema": None if media is None else views.as_object(media).get("schema", {})})
    tags = op.get("tags")
    tags = [t for t in tags if isinstance(t, str)] if isinstance(tags, list) else []
    parts = (jsonwalk.compact(parameters), None if body is None else jsonwalk.compact(body), jsonwalk.compact(responses))
    return (*(_text(op.get(k)) for k in ("operationId", "summary", "description")), tags, op.get("deprecated") is True, *parts)


def endpoint_details(corpus: DataFrame, most: int = MOST_TEXT) -> DataFrame:
    """(eid, method, path, category, operation_id, summary, description, tags, deprecated, parameters, request_body, responses): one row for each method (of seven) and path, all references of its parts expanded.

    Of several documents with one method and path the first by source counts. A request body is the schema of its best media type, null without content; a response has the schema of
    ``application/json`` only. What would be longer than ``most`` characters, or too deep, when expanded stays as it is written. Each document's components are expanded once for all its operations.
    """
    columns = [c.split()[0] for c in _DETAILS.split(", ")]
    types = [pa.list_(pa.string()) if c == "tags" else pa.int32() if c == "ord" else pa.bool_() if c == "deprecated" else pa.string() for c in columns]

    def rows_of(source: str, document: dict) -> list[tuple]:
        expansion, rows = Expansion(document), []

        def expanded(value: object) -> object:
            text, _ = expansion.text(value, most) if isinstance(value, dict) else (None, 0)
            whole = None if text is None else parsed(text)
            return value if whole is None else whole

        title = views.as_object(document.get("info")).get("title", UNTITLED)
        for path, item in views.as_object(document.get("paths")).items():
            item = views.as_object(item)
            for method in ENDPOINTS:
                op = item.get(method)
                if isinstance(op, dict) and op:
                    name = method.upper()
                    rows.append((source, len(rows), f"{name}:{path}", name, path, _text(title), *_operation(op, expanded)))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = list(zip(*rows_of(source, parsed(raw) or {}), strict=True)) or [()] * len(columns)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(made, types, strict=True)], names=columns)

    kept = columns[2:]
    rows = corpus.select("source", "raw").mapInArrow(run, _DETAILS)
    return rows.groupBy("eid").agg(F.min_by(F.struct(*kept[1:]), F.struct("source", "ord")).alias("row")).select("eid", "row.*")


def merged_models(rows: DataFrame, first: Sequence[str], lists: Mapping[str, str], order: str = "ord") -> DataFrame:
    """(identity, ...first, ...lists, required, n): rows (identity, ord, required, ...) of one identity merged.

    Of each column in ``first`` the first filled value counts; each column in ``lists`` (a text or a list; name in the result by column) becomes the list of its filled values, each
    once, by first appearance; required if any row is. Values are merged before they are gathered, so a list is as long as it has different values, however many rows there are.
    """
    filled = [F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col(order))).alias(c) for c in first]
    out = rows.groupBy("identity").agg(*filled, F.bool_or("required").alias("required"), F.count("*").alias("n"))
    is_list = {f.name for f in rows.schema.fields if f.dataType.typeName() == "array"}
    for column, name in lists.items():
        values = F.col(column) if column in is_list else F.array(column)
        each = rows.select("identity", F.col(order).alias("ord"), F.posexplode(values).alias("pos", "v")).where("v IS NOT NULL AND v <> ''")
        once = each.groupBy("identity", "v").agg(F.min(F.struct("ord", "pos")).alias("at"))
        gathered = once.groupBy("identity").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(name))
        out = out.join(gathered, "identity", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


#: The columns and kinds of flattened rows that ``node_summaries`` reads; what a schema requires is a list of constraints.
SUMMARY_KEYS = ("spec_id", "source", "pointer", "parent", "key", "idx", "kind", "value_type", "scalar", "raw")
SUMMARY_KINDS = ("Schema", "Items", "Property", "Constraint")


def node_summaries(ast: DataFrame) -> DataFrame:
    """(node_id, spec_id, kind, pointer, required, type, description, constraints, extensions): overlay nodes of schemas and properties with what each says of itself; the last two are JSON texts with sorted keys.

    A schema node is a named schema, or an inline one that does more than refer (a property: one with a structure of its own). A property is required if the schema around it lists it.
    Rows that have their document's ``source`` keep it.
    """
    of = [c for c in ("spec_id", "source") if c in ast.columns]
    own = ast.where(F.col("kind").isin("Schema", "Items", "Property") & (F.col("value_type") == "object")).select(*of, "pointer", "kind", "key", "raw", without_last(F.col("parent"), 1).alias("holder"))
    extra = F.size(F.array_except(F.json_object_keys("raw"), F.array(*map(F.lit, ("$ref", "description", "summary", "title"))))) == 0
    wrapper = F.coalesce(at("raw", "$ref").isNotNull() & extra, F.lit(False)) & ~F.col("pointer").rlike("^/components/schemas/[^/]+$")
    prop = F.col("kind") == "Property"
    schemas = own.where(~wrapper & (~prop | (property_role() != ""))).select(*of, "pointer", F.lit("Schema").alias("kind"), F.lit(False).alias("required"), "raw")
    needs = ast.where(F.col("idx").isNotNull() & F.col("parent").endswith("/required") & F.col("scalar").startswith('"'))
    needs = needs.select("spec_id", without_last(F.col("parent"), 1).alias("holder"), text_of(F.col("scalar")).alias("key"), F.lit(True).alias("needed")).distinct()
    properties = own.where(prop).join(needs, ["spec_id", "holder", "key"], "left").select(*of, "pointer", F.lit("Property").alias("kind"), F.coalesce("needed", F.lit(False)).alias("required"), "raw")
    rows = schemas.unionByName(properties).withColumn("all", member_map(F.col("raw"))).withColumn("bag", F.map_filter("all", lambda k, _: k.isin(*CONSTRAINTS))).withColumn("more", F.map_filter("all", lambda k, _: k.startswith("x-")))
    key = F.concat(F.lower("kind"), F.lit(":"), F.col("pointer"))
    return rows.select(semantic_id(F.col("spec_id"), F.col("kind"), key).alias("node_id"), *of, "kind", "pointer", "required", *(F.coalesce(text_value(F.col("all")[k]), F.lit("")).alias(k) for k in ("type", "description")), sorted_json(F.col("bag")).alias("constraints"), sorted_json(F.col("more")).alias("extensions"))


def provenance_edges(nodes: DataFrame, ast: DataFrame) -> DataFrame:
    """(kind, source, target, evidence): from each overlay node (node_id, spec_id, pointer) to the value it stands for, each once; nodes that stand for nothing have none."""
    values = ast.select("spec_id", "pointer")
    joined = nodes.where(F.coalesce("pointer", F.lit("")) != "").join(values, ["spec_id", "pointer"])
    return joined.select(F.lit("SEMANTIC_DERIVED_FROM").alias("kind"), F.col("node_id").alias("source"), F.concat_ws("#", "spec_id", "pointer").alias("target"), F.to_json(F.struct("pointer")).alias("evidence")).distinct()


def build_report(components: DataFrame, properties: DataFrame) -> DataFrame:
    """One row of counts: components in all, named, inline (``#`` in the id) and unresolved; properties; properties for each named component; named objects without a property, and their share in per cent of the named."""
    has = properties.groupBy(F.col("component_id").alias("id")).agg(F.count("*").alias("p"))
    inline = F.col("id").contains("#")
    total = components.join(has, "id", "left").agg(
        F.count("*").alias("n_components"), F.count_if(~inline).alias("n_named"), F.count_if(inline).alias("n_inline"), F.count_if(F.col("kind") == "unresolved").alias("n_unresolved"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("n_properties"), F.count_if(~inline & (F.col("shape") == "object") & F.col("p").isNull()).alias("n_empty_named"),
    )
    named = F.greatest("n_named", F.lit(1))
    return total.withColumn("properties_per_named", F.round(F.col("n_properties") / named, 2)).withColumn("empty_named_pct", F.round(F.col("n_empty_named") / named * 100, 1))
