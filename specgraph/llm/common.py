"""Session helpers shared by the operators: the folder that all machines see, row-order keys, linked components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset and all runs on one machine (tests), a temporary one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="specgraph-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder; later plans start there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(doc_id.cast("string")) % F.lit(parts)


#: A key with more than one in so many of the rows is common; there are at most so many common keys.
COMMON = 1000


def common_keys(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys that more than one in ``COMMON`` of the rows has: at most ``COMMON`` of them, as a written table."""
    total = rows.count()
    known = rows.dropna(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"))
    return checkpointed(known.where(F.col("n") * COMMON > total).select(*keys))


def lookup(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """Left join of ``rows`` with a table of one row for each key, whatever share of the rows a key has.

    Common keys, of which there are ``COMMON`` at most, are joined by broadcast where their rows lie; the other rows are shuffled.
    ``rows`` is read several times, so it should be a written table. Null keys find nothing.
    """
    on = list(keys)
    common = common_keys(rows, *keys)
    values = table.join(F.broadcast(common), on, "left_semi")
    held = rows.join(F.broadcast(common.join(values, on, "left")), on)
    others = rows.join(F.broadcast(common), on, "left_anti").join(table, on, "left")
    return held.unionByName(others)


#: Parts that the rows of a common key are spread over.
SPREAD = 64


def spread_join(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """Inner join of ``rows`` with a table that may have many rows for a key, whatever share of the rows a key has.

    The rows of a common key are dealt over ``SPREAD`` parts, and the table's rows of that key are repeated in each. ``rows`` is read
    several times, so it should be a written table.
    """
    on = list(keys)
    common = F.broadcast(common_keys(rows, *keys).withColumn("_hot", F.lit(True)))
    dealt = rows.join(common, on, "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)).cast("int")).otherwise(0)).drop("_hot")
    parts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
    repeated = table.join(common, on, "left").withColumn("_part", F.explode(parts)).drop("_hot")
    return dealt.join(repeated, [*on, "_part"]).drop("_part")


def linked_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Smallest linked node of every node of an undirected edge list, as (node, root).

    Each round gives a node the least label among its own and its neighbours', then follows the label's own label once (so long
    chains halve). Counts of changed rows decide the end; each round is checkpointed. Null ends are ignored. The label of a large
    component is asked for by all its members, so it is found by ``lookup``.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("near")).where("node is not null and near is not null and node <> near")
    both = checkpointed(both.union(both.select("near", "node")).distinct())
    labels = checkpointed(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("root")))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("root").alias("heard"))
        lower = checkpointed(labels.join(heard, "node").select("node", "root", F.least("root", "heard").alias("low")))
        step = lookup(lower, lower.select(F.col("node").alias("low"), F.col("low").alias("far")), "low")
        step = step.select("node", "root", F.coalesce(F.least("low", "far"), F.col("low")).alias("next"))
        step = checkpointed(step)
        changed = step.where("next < root").limit(1).count()
        labels = step.select("node", F.col("next").alias("root"))
        if not changed:
            return labels
