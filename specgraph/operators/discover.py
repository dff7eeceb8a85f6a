"""Discovery over the catalogue tables: body fields, parameters, references, contexts, call validation, path suggestions.

Column names: endpoints (eid, method, path, category, summary, operation_id, tag, deprecated, ord), components (id, name, kind, body_json),
properties (id, component_id, name, required, read_only, device_types, yang_path, type, type_id), bodies (eid, body_id, root_id),
parameters (id, eid, name, location, required), edges (a, b).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specgraph.operators.walk import shared_checkpoint, within

HOPS = 5


def device_filter(wanted: str, column: str = "device_types") -> Column:
    """A null list means all device types, an empty one none; an empty wish takes all."""
    if not wanted:
        return F.lit(True)
    return F.col(column).isNull() | F.array_contains(F.col(column), wanted) | (F.size(column) == 0)


def type_list(column: str) -> Column:
    """A comma-separated text as a list; null stays null, empty becomes an empty list."""
    return F.when(F.col(column).isNull(), F.lit(None)).when(F.col(column) == "", F.array().cast("array<string>")).otherwise(F.split(column, ","))


def body_fields(bodies: DataFrame, composed: DataFrame, properties: DataFrame, hops: int = HOPS) -> DataFrame:
    """(eid, host_id, depth, ...property columns) of every endpoint: properties of the body's root and of what it is composed of.

    The walk is made once for each distinct root, not for each endpoint.
    """
    reach = within(bodies.select(F.col("root_id").alias("root")).distinct(), composed, hops)
    hosts = bodies.select("eid", F.col("root_id").alias("root")).distinct().join(reach, "root")
    own = properties.withColumnRenamed("component_id", "node").withColumnRenamed("id", "property_id")
    return hosts.join(own, "node").withColumnRenamed("node", "host_id").drop("root")


def configures_yang(bodies: DataFrame, composed: DataFrame, values: DataFrame, properties: DataFrame, hops: int = 6) -> DataFrame:
    """(eid, yang_path) over composition and map values, each once."""
    found = body_fields(bodies, composed.select("a", "b").unionByName(values.select("a", "b")), properties, hops)
    return found.where("yang_path <> ''").select("eid", "yang_path").distinct()


def yang_module(path: Column) -> Column:
    """What stands before the colon in the first segment that has one."""
    return F.regexp_extract(path, r"(?:^|/)([^/:]*):", 1)


def endpoint_context(endpoints: DataFrame, parameters: DataFrame, bodies: DataFrame, responses: DataFrame, yang: DataFrame, cli: DataFrame) -> DataFrame:
    """One row per endpoint with its parts as sorted lists, joined to text: each part is aggregated by endpoint before the join."""

    def gathered(df: DataFrame, value: Column, name: str) -> DataFrame:
        return df.groupBy("eid").agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias(name))

    out = endpoints.select("eid")
    parts = [
        gathered(parameters, F.concat_ws(":", "location", "name"), "parameters"), gathered(bodies, F.col("root_id"), "bodies"),
        gathered(responses, F.concat_ws(":", "status", "root_id"), "responses"), gathered(yang, F.col("yang_path"), "yang"), gathered(cli, F.col("command"), "cli"),
    ]
    for part in parts:
        out = out.join(part, "eid", "left")
    return out.na.fill("")


def validate_calls(calls: DataFrame, endpoints: DataFrame, parameters: DataFrame, fields: DataFrame) -> DataFrame:
    """(call_id, known, missing_query, missing_body, undeclared) of every call (call_id, method, path, query_keys, body_keys).

    Required query parameters must be given; POST must give required body fields; keys that no body field has are listed for POST, PUT
    and PATCH. Other locations are not checked, nor bodies of endpoints without body fields. Required sets are made once per endpoint.
    """
    need_query = parameters.where("location = 'query' AND required").groupBy("eid").agg(F.collect_set("name").alias("need_query"))
    body = fields.groupBy("eid").agg(F.collect_set("name").alias("fields"), F.collect_set(F.when(F.col("required"), F.col("name"))).alias("need_body"))
    sets = endpoints.select("eid", F.lit(True).alias("known")).join(need_query, "eid", "left").join(body, "eid", "left")
    joined = calls.withColumn("eid", F.concat(F.upper(F.trim("method")), F.lit(":"), normalised_path(F.col("path")))).join(sets, "eid", "left")

    def text(values: Column) -> Column:
        return F.coalesce(F.array_join(F.array_sort(values), ","), F.lit(""))

    method = F.upper(F.trim("method"))
    return joined.select(
        "call_id", F.coalesce("known", F.lit(False)).alias("known"), text(F.array_except("need_query", "query_keys")).alias("missing_query"),
        F.when(method == "POST", text(F.array_except("need_body", "body_keys"))).otherwise("").alias("missing_body"),
        F.when(method.isin("POST", "PUT", "PATCH"), text(F.array_except("body_keys", "fields"))).otherwise("").alias("undeclared"),
    )


def normalised_path(path: Column) -> Column:
    """Trimmed, with a slash in front."""
    trimmed = F.trim(path)
    return F.when(trimmed.startswith("/"), trimmed).otherwise(F.concat(F.lit("/"), trimmed))


def suggest_paths(unknown: DataFrame, endpoints: DataFrame, segments: int = 3, paths: int = 5) -> DataFrame:
    """(path, suggestion, rank): for each unknown path, the shortest known paths that hold one of its longest segments.

    Version segments and those under three letters do not count. Known paths are split into their segments, so this is an equality
    join; a segment that stands inside a longer one is not looked for.
    """

    def split(column: str) -> Column:
        return F.filter(F.array_distinct(F.split(F.lower(column), "/")), lambda s: (F.length(s) >= 3) & ~s.rlike("^v[0-9]"))

    parts = unknown.select("path").distinct().select("path", F.explode(split("path")).alias("segment"))
    longest = Window.partitionBy("path").orderBy(F.length("segment").desc(), "segment")
    parts = parts.withColumn("n", F.row_number().over(longest)).where(F.col("n") <= segments).drop("n")
    # of each segment only the shortest known paths can be suggested
    known = endpoints.select(F.col("path").alias("suggestion")).distinct().select("suggestion", F.explode(split("suggestion")).alias("segment"))
    short = Window.partitionBy("segment").orderBy(F.length("suggestion"), "suggestion")
    known = known.withColumn("n", F.row_number().over(short)).where(F.col("n") <= paths).drop("n")
    best = Window.partitionBy("path").orderBy(F.length("suggestion"), "suggestion")
    return parts.join(known, "segment").select("path", "suggestion").distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= paths)


#: Longest known segment of which all parts are made; longer ones meet the asked ones on three letters.
SHORT = 64


def suggest_endpoints(unknown: DataFrame, endpoints: DataFrame, segments: int = 3, paths: int = 5) -> DataFrame:
    """(path, rank, method, suggestion): for each unknown path, known endpoints whose path contains one of its longest segments: those of the longest segment first, shortest paths first.

    Version segments do not count, nor do those under three letters among the longest. A segment has no slash, so it stands inside one
    segment of a known path. Known segments are cut into all their parts of three letters and more, and these are joined with the asked
    segments: an equality, whatever letters are frequent. Of each known segment, and of each asked one, only the shortest paths can be suggested.
    """

    def parts_of(column: str, length: Column) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(column) - length + 1), lambda i: F.substring(F.col(column), i, length)))

    pieces = unknown.select("path").distinct().select("path", F.posexplode(F.split("path", "/")).alias("pos", "segment"))
    pieces = pieces.where((F.col("segment") != "") & ~F.col("segment").rlike(r"(?i)^v\d+([a-z]+\d*)?$"))
    longest = Window.partitionBy("path").orderBy(F.length("segment").desc(), "pos")
    pieces = pieces.withColumn("n", F.row_number().over(longest)).where((F.col("n") <= segments) & (F.length("segment") >= 3)).select("path", "n", "segment")
    known = endpoints.select("method", F.col("path").alias("suggestion")).distinct().select("method", "suggestion", F.explode(F.array_distinct(F.split("suggestion", "/"))).alias("part")).where(F.length("part") >= 3)
    by_part = Window.partitionBy("part").orderBy(F.length("suggestion"), "suggestion", "method")
    known = shared_checkpoint(known.withColumn("k", F.row_number().over(by_part)).where(F.col("k") <= paths).drop("k"))
    asked = shared_checkpoint(pieces.select("segment").distinct())
    parts = known.select("part").distinct()
    lengths = parts.where(F.length("part") <= SHORT).select("part", F.explode(F.sequence(F.lit(3), F.length("part"))).alias("size"))
    inside = lengths.select("part", F.explode(parts_of("part", F.col("size"))).alias("segment")).join(asked, "segment").select("segment", "part")
    far = parts.where(F.length("part") > SHORT).select("part", F.explode(parts_of("part", F.lit(3))).alias("gram"))
    rare = asked.select("segment", F.explode(parts_of("segment", F.lit(3))).alias("gram")).join(far.groupBy("gram").agg(F.count("*").alias("df")), "gram").groupBy("segment").agg(F.min_by("gram", F.struct("df", "gram")).alias("gram"))
    inside = inside.unionByName(rare.join(far, "gram").where(F.contains("part", "segment")).select("segment", "part"))
    short = Window.partitionBy("segment").orderBy(F.length("suggestion"), "suggestion", "method")
    found = inside.join(known, "part").select("segment", "method", "suggestion").distinct().withColumn("k", F.row_number().over(short)).where(F.col("k") <= paths).drop("k")
    hits = pieces.join(found, "segment").groupBy("path", "method", "suggestion").agg(F.min("n").alias("n"))
    best = Window.partitionBy("path").orderBy("n", F.length("suggestion"), "suggestion", "method")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= paths).select("path", "rank", "method", "suggestion")


def oversize(column: str, cap: int = 4096, preview: int = 200) -> list[Column]:
    """(truncated, shown, size_bytes): a value over the cap in UTF-8 bytes shows its first signs only."""
    size = F.octet_length(column)
    return [(size > cap).alias("truncated"), F.when(size > cap, F.substring(column, 1, preview)).otherwise(F.col(column)).alias("shown"), size.cast("long").alias("size_bytes")]


def capped(df: DataFrame, order: list[Column], soft: int = 200, hard: int = 2000) -> DataFrame:
    """The first rows by an order, at most min(soft, hard), each with the count of all rows: the caps are the feature."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).limit(min(soft, hard)).crossJoin(F.broadcast(total))  # one row
