"""Audits: invariants with samples, parity of two builds, coverage metrics, gates, sync health, fingerprints, size profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specgraph.operators.walk import shared_checkpoint


def invariant(name: str, offenders: DataFrame, sample: int = 25) -> DataFrame:
    """(invariant, n, sample): offenders (one ``detail`` column) counted, the least few as a sample: the cap is the feature.

    Each task keeps its own least few before they meet.
    """
    least = offenders.select("detail").orderBy("detail").limit(sample)
    count = offenders.agg(F.count("*").alias("n"))
    text = least.agg(F.coalesce(F.array_join(F.array_sort(F.collect_list("detail")), ","), F.lit("")).alias("sample"))
    return count.crossJoin(text).select(F.lit(name).alias("invariant"), "n", "sample")  # one row each


def dangling(edges: DataFrame, end: str, nodes: DataFrame, key: str) -> DataFrame:
    """Edges an end of which is no node's key."""
    return edges.join(nodes.select(F.col(key).alias(end)), end, "left_anti").select(F.col(end).alias("detail")).distinct()


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(F.col(key).alias("detail"))


SHAPES = ("object", "union-oneOf", "union-anyOf", "allOf-composite", "map")


def graph_invariants(t: Mapping[str, DataFrame]) -> DataFrame:
    """The ten invariants of a typed graph, each with its offenders counted and sampled.

    ``component`` (id, kind, body, shape, named), ``property`` (id, parent, name), ``command`` (id), ``yang`` (path, module), and edges
    (a, b): ``has_property``, ``composed``, ``value``, ``has_command`` (endpoint, command), ``in_module`` (path, module).
    """
    c, p, has = t["component"], t["property"], t["has_property"].distinct()
    full = c.where("body <> ''")
    fields = F.col("body").contains('"properties"')

    def without(rows: DataFrame, edges: DataFrame) -> DataFrame:
        return rows.join(edges.select(F.col("a").alias("id")).distinct(), "id", "left_anti")

    def not_once(nodes: DataFrame, ends: DataFrame) -> DataFrame:
        """Nodes that other than one edge leads to or from; both have ``detail``."""
        return nodes.distinct().join(ends.groupBy("detail").agg(F.count("*").alias("n")), "detail", "left").where(F.coalesce("n", F.lit(0)) != 1).select("detail")

    leaf = without(without(without(full.where(F.col("shape").isin(*SHAPES) & ~F.col("kind").isin("primitive", "unresolved") & F.col("named") & ((F.col("shape") != "object") | fields)), has), t["composed"]), t["value"])
    from_component = has.join(c.select(F.col("id").alias("a")).distinct(), "a", "left_semi")
    modules = t["yang"].where("module <> ''")
    found = {
        "INV-1": leaf.select(F.col("id").alias("detail")),
        "INV-2": full.where(F.col("shape").isin(*SHAPES) & (F.col("kind") == "primitive")).select(F.col("id").alias("detail")),
        "INV-3": duplicates(c, "id"),
        "INV-5": has.join(p.select(F.col("id").alias("b"), "name"), "b").groupBy("a", "name").agg(F.count("*").alias("n")).where("n > 1").select(F.concat_ws("|", "a", "name").alias("detail")),
        "INV-6": without(full.where((F.col("shape") == "object") & fields & (F.col("kind") != "unresolved") & F.col("named")), has).select(F.col("id").alias("detail")),
        "INV-7": full.where((F.col("shape").isin(*SHAPES) & (F.col("kind") == "primitive")) | ((F.col("shape") == "primitive") & (F.col("kind") == "object"))).select(F.col("id").alias("detail")),
        "INV-8": p.join(from_component.select(F.col("b").alias("id")).distinct(), "id", "left_anti").select(F.col("id").alias("detail")),
        "INV-9": p.where("parent <> ''").join(from_component.select(F.col("a").alias("parent"), F.col("b").alias("id")), ["parent", "id"], "left_anti").select(F.col("id").alias("detail")),
        "INV-13": not_once(t["command"].select(F.col("id").alias("detail")), t["has_command"].select(F.col("b").alias("detail"))),
        "INV-14": not_once(modules.select(F.concat_ws("|", "path", "module").alias("detail")), t["in_module"].select(F.concat_ws("|", "a", "b").alias("detail"))),
    }
    return invariants(found)


def invariants(found: Mapping[str, DataFrame], sample: int = 25) -> DataFrame:
    """``invariant`` of several tables of offenders: they are written once, then counted and sampled together."""
    every = shared_checkpoint(union_all([d.select(F.lit(n).alias("invariant"), "detail") for n, d in found.items()]))
    counts = every.groupBy("invariant").agg(F.count("*").alias("n"))
    least = every.withColumn("k", F.row_number().over(Window.partitionBy("invariant").orderBy("detail"))).where(F.col("k") <= sample)
    samples = least.groupBy("invariant").agg(F.array_join(F.array_sort(F.collect_list("detail")), ",").alias("sample"))
    names = every.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, found))).alias("invariant"))
    return names.join(counts, "invariant", "left").join(samples, "invariant", "left").select("invariant", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sample", F.lit("")).alias("sample"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class InvariantError(AssertionError):
    """Some invariant has offenders."""


def gate(report: DataFrame) -> None:
    """Raises with the report's text if any invariant has offenders."""
    bad = report.where("n > 0").orderBy("invariant").collect()  # a row per invariant
    if bad:
        raise InvariantError("; ".join(f"{r['invariant']}: {r['n']} ({r['sample']})" for r in bad))


def parity(left: DataFrame, right: DataFrame) -> DataFrame:
    """(check, n_left, n_right, missing, extra, coverage) of two (check, key) tables.

    One shuffle for all checks: each key becomes one row with the sides that have it. Coverage is the share of the left side's keys
    that the right side has, 1.0 if there are none.
    """
    keys = left.select("check", "key", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select("check", "key", F.lit(0).alias("l"), F.lit(1).alias("r")))
    sides = keys.groupBy("check", "key").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    sums = sides.groupBy("check").agg(F.sum("l").alias("n_left"), F.sum("r").alias("n_right"), F.sum(F.col("l") * (1 - F.col("r"))).alias("missing"), F.sum(F.col("r") * (1 - F.col("l"))).alias("extra"))
    return sums.withColumn("coverage", ratio(F.col("n_left") - F.col("missing"), F.col("n_left"), 1.0))


#: Fixed value: ids of components that were named by their shape.
SYNTHETIC = ":Shape_[0-9a-f]+$"


def without_variant(id_: Column) -> Column:
    """An id without its ``@`` and 12 hex digits, wherever they stand."""
    return F.regexp_replace(id_, "@[0-9a-f]{12}", "")


def excuses(left: DataFrame, right: DataFrame, targets: Sequence[str] | None = None) -> DataFrame:
    """(check, key, excuse) of every key the right side lacks: alias, target, structural or open, the first that holds.

    A key is an alias if it is there without its variant suffix. An edge key ``a|b`` has an alternate target if its first part occurs
    once on either side with another second part (``targets``: only in these checks). With a ``shape`` column on both sides, a key of a
    synthetic component is excused if the right side has an equal shape, for keys ``a|b`` with an equal second part.
    """
    missing = left.join(right, ["check", "key"], "left_anti").distinct()
    bare_right = right.select("check", without_variant(F.col("key")).alias("bare")).distinct().withColumn("alias", F.lit(True))
    marked = missing.withColumn("bare", without_variant(F.col("key"))).join(bare_right, ["check", "bare"], "left")

    def once(rows: DataFrame, name: str) -> DataFrame:
        own = rows if targets is None else rows.where(F.col("check").isin(list(targets)))
        return own.select("check", "key").where("contains(key, '|')").distinct().groupBy("check", F.substring_index("key", "|", 1).alias("context")).agg(F.count("*").alias(name)).where(f"{name} = 1")

    both = once(left, "nl").join(once(right, "nr"), ["check", "context"]).select("check", "context", F.lit(True).alias("target"))
    marked = marked.withColumn("context", F.substring_index("key", "|", 1)).join(both, ["check", "context"], "left")
    structural = F.lit(False)
    if "shape" in left.columns:
        member = F.when(F.contains("key", F.lit("|")), F.substring_index("key", "|", -1)).otherwise("").alias("member")
        shapes = right.where("shape <> ''").select("check", "shape", member).distinct().withColumn("equal", F.lit(True))
        marked = marked.select("*", member).join(shapes, ["check", "shape", "member"], "left")
        structural = F.coalesce("equal", F.lit(False)) & F.col("context").rlike(SYNTHETIC)
    excuse = F.when(F.coalesce("alias", F.lit(False)), "alias").when(F.coalesce("target", F.lit(False)), "target").when(structural, "structural").otherwise("open")
    return marked.select("check", "key", excuse.alias("excuse"))


def excused(left: DataFrame, right: DataFrame) -> DataFrame:
    """(check, n_missing, n_alias, n_target, n_open): keys the right side lacks, and how many of them have which excuse."""
    names = ("alias", "target", "open")
    return excuses(left, right).groupBy("check").agg(F.count("*").alias("n_missing"), *[F.count_if(F.col("excuse") == n).alias(f"n_{n}") for n in names])


def ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    """Share to four decimals; a set value where there is nothing."""
    return F.when(whole == 0, F.lit(empty)).otherwise(F.round(part / whole, 4))


def coverage(nodes: DataFrame, key: str, has: Mapping[str, DataFrame]) -> DataFrame:
    """One row: total, and the share of nodes whose key occurs in each other table's ``key``."""
    out = nodes.select(F.col(key).alias("key")).distinct()
    for name, table in has.items():
        out = out.join(table.select("key").distinct().withColumn(name, F.lit(1)), "key", "left")
    return out.agg(F.count("*").alias("total"), *[ratio(F.count(n), F.count("*")).alias(f"has_{n}") for n in has])


def merged_metrics(parts: DataFrame) -> DataFrame:
    """Counts of partial reports (metric, part, whole) summed, and ratios made again from the sums."""
    sums = parts.groupBy("metric").agg(F.sum("part").alias("part"), F.sum("whole").alias("whole"))
    return sums.withColumn("ratio", ratio(F.col("part"), F.col("whole")))


def sync_health(sources: DataFrame) -> DataFrame:
    """Per source (source, found, fetched, failure): coverage and ok, degraded (under 0.95) or error (nothing fetched), and failures by kind."""
    own = sources.groupBy("source").agg(F.count("*").alias("discovered"), F.count_if("fetched").alias("fetched"))
    kinds = sources.where(F.col("failure") != "").groupBy("source", "failure").agg(F.count("*").alias("n"))
    texts = kinds.groupBy("source").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "failure", F.col("n").cast("string")))), ",").alias("failures"))
    share = ratio(F.col("fetched"), F.col("discovered"), 1.0)
    status = F.when(F.col("fetched") == 0, "error").when(share < 0.95, "degraded").otherwise("ok")
    return own.join(texts, "source", "left").select("source", "discovered", "fetched", (F.col("discovered") - F.col("fetched")).alias("missing"), share.alias("coverage"), status.alias("status"), F.coalesce("failures", F.lit("")).alias("failures"))


def corpus_fingerprint(rows: DataFrame, text: Column, buckets: int = 4096) -> DataFrame:
    """sha256 over bucket digests: records are hashed, bucketed by their hash, sorted and hashed within buckets, and the buckets' digests in order.

    The result does not depend on row order or partitions. Repeated records count as often as they occur.
    """
    hashed = rows.select(F.sha2(text, 256).alias("h"))
    bucket = F.conv(F.substring("h", 1, 3), 16, 10).cast("int") % buckets
    parts = hashed.groupBy(bucket.alias("bucket"), "h").agg(F.count("*").alias("n"))
    digests = parts.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("*", "h", F.col("n").cast("string")))), ""), 256).alias("d"))
    return digests.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "d"))), lambda x: x["d"]), ""), 256).alias("fingerprint"))


def size_profile(rows: DataFrame, size: str, group: str) -> DataFrame:
    """Per group: count, sum, least, nearest-rank percentiles on n - 1, most, mean. Ranks come from counts of equal sizes, so a hot group is small."""
    counted = rows.groupBy(group, F.col(size).cast("long").alias("size")).agg(F.count("*").alias("k"))
    upto = Window.partitionBy(group).orderBy("size")
    ranked = counted.withColumn("last", F.sum("k").over(upto) - 1).withColumn("first", F.col("last") - F.col("k") + 1).withColumn("total", F.sum("k").over(Window.partitionBy(group)))

    def at(p: float) -> Column:
        rank = F.round(F.lit(p) * (F.col("total") - 1)).cast("long")
        return F.max(F.when((F.col("first") <= rank) & (F.col("last") >= rank), F.col("size")))

    return ranked.groupBy(group).agg(
        F.sum("k").alias("n"), F.sum(F.col("k") * F.col("size")).alias("total_size"), F.min("size").alias("least"), *[at(p / 100).alias(f"p{p}") for p in (50, 90, 95, 99)], F.max("size").alias("most"), F.round(F.sum(F.col("k") * F.col("size")) / F.sum("k"), 4).alias("mean")
    )


def top_share(rows: DataFrame, size: str, key: str, tops: Sequence[int] = (1, 5, 10, 25, 50, 100, 250, 500, 1000)) -> DataFrame:
    """(top, share): share of all sizes that the largest few rows have. Only the largest ``max(tops)`` rows meet in one place."""
    largest = rows.orderBy(F.desc(size), key).limit(max(tops)).select(F.col(size).alias("size"), F.col(key).alias("key"))
    running = largest.select(F.row_number().over(Window.orderBy(F.desc("size"), "key")).alias("top"), F.sum("size").over(Window.orderBy(F.desc("size"), "key").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    total = rows.agg(F.sum(size).alias("total"))
    return running.where(F.col("top").isin(list(tops))).crossJoin(F.broadcast(total)).select("top", F.round(F.col("upto") / F.col("total"), 4).alias("share"))  # one row


def byte_budget(rows: DataFrame, query: str, order: str, text: Column, cap: int = 50_000, width: int = 1000) -> DataFrame:
    """(query, kept, dropped): rows in order until their texts' bytes pass the cap; ``order`` is a whole number.

    The place is found from coarse to fine: sums over blocks of ``width`` squared values of ``order`` give the block in which a query
    passes the cap, sums over ``width`` values within it the finer one, and last the single values. A window sees blocks of a query or
    the values of one block, never all its rows. Rows of equal ``order`` go together. Null texts take no bytes; rows without ``order``
    come first.
    """
    least = F.lit(-(2**63)).cast("long")
    sized = rows.select(F.col(query).alias("q"), F.coalesce(F.col(order).cast("long"), least).alias("at"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("size"))
    sums = sized.groupBy("q", "at").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    parts = [sums.groupBy("q").agg(F.lit(0).cast("long").alias("kept"), F.sum("n").alias("n"))]
    cut = None
    for step in (width * width, width, 1):
        level = sums.groupBy("q", F.expr(f"at div {step}").alias("block")).agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
        if cut is None:
            level = level.withColumn("base", F.lit(0).cast("long"))
        else:
            level = level.join(cut, F.col("q").eqNullSafe(F.col("of")) & (F.expr(f"block div {width}") == F.col("inside")))
        earlier = F.sum("size").over(Window.partitionBy("q").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
        level = level.withColumn("before", F.col("base") + F.coalesce(earlier, F.lit(0)))
        parts.append(level.where(F.col("before") + F.col("size") <= cap).select("q", F.col("n").alias("kept"), F.lit(0).cast("long").alias("n")))
        cut = level.where((F.col("before") <= cap) & (F.col("before") + F.col("size") > cap)).select(F.col("q").alias("of"), F.col("block").alias("inside"), F.col("before").alias("base"))
    return union_all(parts).groupBy(F.col("q").alias(query)).agg(F.sum("kept").alias("kept"), (F.sum("n") - F.sum("kept")).alias("dropped"))


def path_tree(endpoints: DataFrame) -> DataFrame:
    """(category, path, methods, deprecated): methods of a path sorted and joined by a bar."""
    return endpoints.groupBy("category", "path").agg(F.array_join(F.array_sort(F.collect_set("method")), "|").alias("methods"), F.bool_or("deprecated").alias("deprecated"))
