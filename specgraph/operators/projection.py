"""From document rows to typed ids and edges: device types, inline components, command rows, constraints, direct and provenance edges, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specgraph.operators.specs import NO_SCHEMAS, flatten, references, semantic_id
from specgraph.operators.walk import shared_checkpoint

CONSTRAINTS = (
    "const", "default", "deprecated", "enum", "exclusiveMaximum", "exclusiveMinimum", "maxContains", "maximum", "maxItems", "maxLength", "maxProperties", "minContains", "minimum", "minItems", "minLength",
    "minProperties", "multipleOf", "nullable", "pattern", "readOnly", "required", "uniqueItems", "writeOnly", "x-enumDescriptions", "x-key",
)
#: What an inline schema is called after its parent, by the keyword that holds it. List branches have their place as well.
INLINE = {"items": "items", "additionalProperties": "additionalProperties"}


def at(raw: str, key: str) -> Column:
    return F.get_json_object(raw, f"$['{key}']")


def device_types(raw: str = "raw") -> Column:
    """``x-supportedDeviceType`` as a list: a list's texts, a text alone as a list of one, null if absent (all types)."""
    value = at(raw, "x-supportedDeviceType")
    as_list = F.from_json(value, "array<string>")
    return F.when(value.isNull(), F.lit(None)).when(value.startswith("["), as_list).otherwise(F.array(value))


def named_part(pointer: Column) -> Column:
    return F.regexp_extract(pointer, r"^/components/schemas/([^/]+)", 1)


def component_id(provider: Column, pointer: Column) -> Column:
    """The id of the component at a pointer below a named schema, from its lineage: ``#prop:x`` and the shape, ``#allOf:0``, ``#items`` and so on.

    Properties named like keywords keep their ``prop:`` mark, so ids do not clash.
    """
    inner = F.regexp_replace(pointer, r"^/components/schemas/[^/]+", "")
    marked = F.regexp_replace(inner, r"/properties/([^/]+)", "#prop:$1")
    marked = F.regexp_replace(marked, r"/(allOf|oneOf|anyOf)/([0-9]+)", "#$1:$2")
    marked = F.regexp_replace(marked, r"/(items|additionalProperties)(?=#|/|$)", "#$1")
    return F.concat(provider, F.lit(":schemas:"), named_part(pointer), marked)


def inline_components(ast: DataFrame, specs: DataFrame) -> DataFrame:
    """(id, parent_id, role, pointer, spec_id) of inline schemas with a structure of their own (object, map or union) below named schemas.

    On document rows no recursion is needed: the pointer holds the lineage.
    """
    own = ast.where(F.col("kind").isin("Property", "Items", "Schema") & (F.col("value_type") == "object") & F.col("pointer").rlike("^/components/schemas/[^/]+/.")).join(specs.select("spec_id", "spec_source"), "spec_id")
    return inline_of(own, "spec_id")


def inline_values(corpus: DataFrame) -> DataFrame:
    """(spec_source, pointer, parent, key, kind, raw) of the schemas below named ones, with their provider; nothing below paths, constraints and extensions is a row."""
    rows = flatten(corpus, ("spec_source", "pointer", "parent", "key", "kind", "value_type", "raw"), ("Property", "Items", "Schema"), NO_SCHEMAS)
    return rows.where((F.col("value_type") == "object") & F.col("pointer").rlike("^/components/schemas/[^/]+/."))


def inline_of(own: DataFrame, *more: str) -> DataFrame:
    """``inline_components`` from schemas (spec_source, pointer, parent, key, kind, raw) below named ones."""
    structured = F.coalesce(at("raw", "properties"), at("raw", "additionalProperties"), at("raw", "allOf"), at("raw", "oneOf"), at("raw", "anyOf")).isNotNull()
    rows = own.where(structured & at("raw", "$ref").isNull())
    role = F.when(F.col("kind") == "Property", "object").otherwise(F.coalesce(F.col("key"), F.regexp_extract("parent", "([^/]+)$", 1)))
    up = F.regexp_replace("pointer", r"/(?:properties/[^/]+|(?:allOf|oneOf|anyOf)/[0-9]+|items|additionalProperties)$", "")
    return rows.select(component_id(F.col("spec_source"), F.col("pointer")).alias("id"), component_id(F.col("spec_source"), up).alias("parent_id"), role.alias("role"), "pointer", *more)


def cli_rows(ast: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(id, eid, command, param_keys) from ``x-cliParam`` of operations; keys may be texts or objects with ``key``."""
    own = ast.where("key = 'x-cliParam' AND value_type = 'object'").select("spec_id", F.col("parent").alias("pointer"), "raw")
    return commands(own.join(endpoints.select("eid", "spec_id", "pointer"), ["spec_id", "pointer"]))


def commands(own: DataFrame) -> DataFrame:
    """``cli_rows`` from endpoints (eid, raw) with the text of their command; those without one have no row."""
    command = F.get_json_object("raw", "$.commandName")
    keys = F.transform(F.from_json(F.get_json_object("raw", "$.paramKeys"), "array<string>"), lambda k: F.coalesce(F.get_json_object(k, "$.key"), k))
    return own.where("raw IS NOT NULL").select(F.concat_ws("::", "eid", command).alias("id"), "eid", command.alias("command"), F.coalesce(keys, F.array().cast("array<string>")).alias("param_keys"))


def constraints(raw: str = "raw") -> list[Column]:
    """Typed columns (booleans are not numbers) and the bag of all constraint keywords as JSON text."""

    def number(key: str, kind: str) -> Column:
        return F.when(at(raw, key).rlike(r"^-?[0-9.eE+-]+$"), at(raw, key).cast(kind))

    bag = F.map_filter(F.create_map(*[x for k in CONSTRAINTS for x in (F.lit(k), at(raw, k))]), lambda _, v: v.isNotNull())
    return [number("minimum", "double").alias("minimum"), number("maximum", "double").alias("maximum"), number("minLength", "long").alias("min_length"), number("maxLength", "long").alias("max_length"), F.to_json(bag).alias("constraints")]


def schema_edges(ast: DataFrame) -> DataFrame:
    """(kind, source, target, evidence): operation to the schema its body accepts or a response returns, each once."""
    refs = references(ast).where("target IS NOT NULL").where(F.col("pointer").rlike(r"^/paths/[^/]+/[^/]+/(requestBody|responses)/"))
    op = F.regexp_extract("pointer", r"^(/paths/[^/]+/[^/]+)/", 1)
    kind = F.when(F.col("pointer").contains("/requestBody/"), "ACCEPTS_SCHEMA").otherwise("RETURNS_SCHEMA")
    evidence = F.to_json(F.struct(F.regexp_extract("pointer", "/responses/([^/]+)/", 1).alias("status"), F.replace(F.regexp_extract("pointer", "/content/([^/]+)/", 1), F.lit("~1"), F.lit("/")).alias("media")))
    rows = refs.select("spec_id", kind.alias("kind"), op.alias("op"), "target", evidence.alias("evidence"))
    return rows.select("kind", semantic_id(F.col("spec_id"), F.lit("Endpoint"), F.col("op")).alias("source"), semantic_id(F.col("spec_id"), F.lit("Schema"), F.col("target")).alias("target"), "evidence").distinct()


def type_edges(ast: DataFrame, specs: DataFrame) -> DataFrame:
    """(kind, a, b): property to the component it refers to (PROPERTY_OF_TYPE) or whose items it refers to (HAS_ITEM_SCHEMA), composition branches (COMPOSED_OF) and map values (HAS_VALUE_SCHEMA)."""
    return type_edges_of(references(ast).join(specs.select("spec_id", "spec_source"), "spec_id"))


def type_edges_of(refs: DataFrame) -> DataFrame:
    """``type_edges`` from references (spec_source, pointer, ref)."""
    refs = refs.where("ref LIKE '#/components/schemas/%' AND pointer LIKE '/components/schemas/%'")
    target = F.concat(F.col("spec_source"), F.lit(":schemas:"), F.expr("substring(ref, 22)"))
    kind = (
        F.when(F.col("pointer").rlike(r"/properties/[^/]+$"), "PROPERTY_OF_TYPE").when(F.col("pointer").rlike(r"/(allOf|oneOf|anyOf)/[0-9]+$"), "COMPOSED_OF")
        .when(F.col("pointer").rlike(r"/additionalProperties$"), "HAS_VALUE_SCHEMA").when(F.col("pointer").rlike(r"/items$"), "HAS_ITEM_SCHEMA")
    )
    holder = F.when(kind == "PROPERTY_OF_TYPE", F.col("pointer")).otherwise(F.regexp_replace("pointer", r"/(?:(?:allOf|oneOf|anyOf)/[0-9]+|items|additionalProperties)$", ""))
    return refs.select(kind.alias("kind"), component_id(F.col("spec_source"), holder).alias("a"), target.alias("b")).where("kind IS NOT NULL").distinct()


def reusable_parts(ast: DataFrame, specs: DataFrame) -> DataFrame:
    """(id, section, name) of reusable components that are no schemas."""
    return parts_of(ast.join(specs.select("spec_id", "spec_source"), "spec_id"))


def parts_of(values: DataFrame) -> DataFrame:
    """``reusable_parts`` from values (spec_source, pointer, key, depth); nothing below the third level counts."""
    own = values.where("depth = 3 AND pointer LIKE '/components/%' AND pointer NOT LIKE '/components/schemas/%'")
    section = F.regexp_extract("pointer", "^/components/([^/]+)/", 1)
    return own.select(F.concat_ws(":", "spec_source", section, "key").alias("id"), section.alias("section"), F.col("key").alias("name")).distinct()


def resolve_two_scopes(refs: DataFrame, local: DataFrame, shared: DataFrame) -> DataFrame:
    """(source, name, body, scope): the richer of the document's own body and the provider's; the own one of equals; unknown names have none.

    refs (source, provider, name), local (source, name, body), shared (provider, name, body).
    """
    own = local.select("source", "name", F.col("body").alias("own"))
    pool = shared.select("provider", "name", F.col("body").alias("pool"))
    joined = refs.join(own, ["source", "name"], "left").join(pool, ["provider", "name"], "left")
    take_own = F.col("own").isNotNull() & (F.col("pool").isNull() | (F.length("own") >= F.length("pool")))
    scope = F.when(take_own, "own").when(F.col("pool").isNotNull(), "provider").otherwise("none")
    return joined.select("source", "name", F.when(take_own, F.col("own")).otherwise(F.col("pool")).alias("body"), scope.alias("scope"))


def subtree_hashes(ast: DataFrame) -> DataFrame:
    """(spec_id, pointer, hash) of every value: equal values have equal hashes, whatever the order of their keys and the document they are in.

    A value's hash is made of those of its members, so levels are hashed from the deepest up, a round of one group by parent for each; a group is
    the members of one value. No text of a nested value is needed.
    """
    rows = shared_checkpoint(ast.select("spec_id", "pointer", "parent", "key", "idx", "value_type", "scalar", "depth"))
    deepest = rows.agg(F.coalesce(F.max("depth"), F.lit(-1))).first()[0]
    below = every = None
    for depth in range(deepest, -1, -1):
        level = rows.where(F.col("depth") == depth)
        if below is None:
            members = level.limit(0).select("spec_id", "pointer", F.lit("").alias("members"))
        else:
            each = F.array_sort(F.collect_list(F.struct(F.coalesce("idx", F.lit(-1)).alias("idx"), F.coalesce("key", F.lit("")).alias("key"), "hash")))
            members = below.groupBy("spec_id", F.col("parent").alias("pointer")).agg(F.to_json(F.transform(each, lambda m: F.struct(m["key"].alias("k"), m["hash"].alias("h")))).alias("members"))
        text = F.when(F.col("value_type") == "scalar", F.concat(F.lit("="), F.col("scalar"))).otherwise(F.concat(F.col("value_type"), F.coalesce("members", F.lit(""))))
        below = shared_checkpoint(level.join(members, ["spec_id", "pointer"], "left").select("spec_id", "pointer", "parent", "key", "idx", F.sha1(text).alias("hash")))
        own = below.select("spec_id", "pointer", "hash")
        every = own if every is None else every.unionByName(own)
    return rows.select("spec_id", "pointer", F.lit("").alias("hash")).limit(0) if every is None else every


def shared_objects(ast: DataFrame, least: int = 2, properties: int = 3) -> DataFrame:
    """(hash, names, n, n_specs): inline objects with so many properties that stand in ``least`` places or more, over all documents: the counterpart of components within one. ``names`` are those of their properties, sorted."""
    named = ast.where(F.col("parent").endswith("/properties")).groupBy("spec_id", F.regexp_replace("parent", "/properties$", "").alias("pointer")).agg(F.array_sort(F.collect_list("key")).alias("names"))
    typed = ast.where((F.col("key") == "type") & (F.col("scalar") == '"object"')).select("spec_id", F.col("parent").alias("pointer"))
    inline = named.where((F.size("names") >= properties) & ~F.col("pointer").rlike("^/components/[^/]+/[^/]+$")).join(typed, ["spec_id", "pointer"], "left_semi")
    found = inline.join(subtree_hashes(ast), ["spec_id", "pointer"])
    # first by document, so that a shape that most documents have meets as one row from each
    by_spec = found.groupBy("hash", "spec_id").agg(F.count("*").alias("n"), F.min(F.array_join("names", ",")).alias("names"))
    return by_spec.groupBy("hash").agg(F.min("names").alias("names"), F.sum("n").alias("n"), F.count("*").alias("n_specs")).where(F.col("n") >= least)


def find_endpoints(endpoints: DataFrame, wanted: DataFrame) -> DataFrame:
    """(call, eid): asked by method and path, or by operation id; the exact path comes first."""
    by_path = wanted.join(endpoints.select("method", "path", "eid"), ["method", "path"]).select("call", "eid", F.lit(0).alias("n"))
    by_id = wanted.join(endpoints.where("operation_id <> ''").select("operation_id", "eid"), "operation_id").select("call", "eid", F.lit(1).alias("n"))
    best = Window.partitionBy("call").orderBy("n", "eid")
    return by_path.unionByName(by_id).withColumn("k", F.row_number().over(best)).where("k = 1").select("call", "eid")


def yang_rows(properties: DataFrame, path: str = "yang_path") -> DataFrame:
    """(kind, id, module): every model path with its module, what stands before the colon of the first segment that has one (empty if none has), and every module."""
    paths = properties.where(F.col(path) != "").select(F.col(path).alias("id")).distinct().withColumn("module", F.regexp_extract("id", "(?:^|/)([^/:]*):", 1))
    return paths.select(F.lit("YangPath").alias("kind"), "id", "module").unionByName(paths.where("module <> ''").select(F.lit("YangModule").alias("kind"), F.col("module").alias("id"), "module").distinct())


def projection_map(rows: DataFrame) -> DataFrame:
    """Map rows from typed rows to overlay and AST nodes, each once: the id is the table, the row and a hash of what the row came from.

    Rows of one id from several runs become one, with the least source and status; a row of other origin is kept beside it.
    """
    key = ["table_name", "row_id", "semantic_id", "ast_id", "spec_id", "pointer"]
    origin = F.concat_ws("|", *(F.coalesce(F.col(c), F.lit("")) for c in key))
    # the id follows from the key, so it is made when rows have met and does not move with them
    merged = rows.groupBy(*key).agg(F.min("source").alias("source"), F.min("status").alias("status"))
    return merged.select(F.concat_ws(":", "table_name", "row_id", F.substring(F.sha1(origin), 1, 16)).alias("projection_id"), *key, "source", "status")
