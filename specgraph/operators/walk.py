"""Bounded and unbounded walks over edge tables, by joins of a frontier."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, that of spark.checkpoint.dir (a temporary one only where that is unset and all runs on one machine, as in tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="specgraph-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_folder(spark: SparkSession, name: str = "tables") -> str:
    """A new path in the checkpoint folder; who owns that folder deletes it, with all that jobs leave there."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder as a compressed table and read back.

    What is read has the size of its own files. A frame of ``checkpoint()`` keeps the estimate of the plan that made it: documents and rows
    made of them seem as small as the table they come from, so that they are broadcast, and estimates of rounds of joins multiply by each other.
    """
    path = scratch_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def within(roots: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(root, node, depth): nodes at most ``hops`` steps from each root over (a, b) edges, by their least depth.

    Only the last step's new pairs move on, and a (root, node) pair moves on once, so hubs do not multiply rows. Each hop's new pairs
    are checkpointed, so no hop computes those before it again; the walk ends early when there are none.
    """
    steps = shared_checkpoint(edges.select(F.col("a").alias("node"), F.col("b").alias("next")).distinct())
    front = shared_checkpoint(roots.select(F.col("root"), F.col("root").alias("node")).distinct())
    every = front.withColumn("depth", F.lit(0))
    for depth in range(1, hops + 1):
        reached = front.join(steps, "node").select("root", F.col("next").alias("node")).distinct()
        front = shared_checkpoint(reached.join(every, ["root", "node"], "left_anti"))
        if front.isEmpty():
            break
        every = every.unionByName(front.withColumn("depth", F.lit(depth)))
    return every


def closure(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, node): all nodes reachable from each root, itself included.

    Each round writes the new pairs alone, so what is written in all is the result once; they are told from the old by an anti join with
    the rounds before, which are read and not written again. Rounds end when no pair is new.
    """
    steps = shared_checkpoint(edges.select(F.col("a").alias("node"), F.col("b").alias("next")).distinct())
    front = shared_checkpoint(roots.select(F.col("root"), F.col("root").alias("node")).distinct())
    every = front
    while True:
        reached = front.join(steps, "node").select("root", F.col("next").alias("node")).distinct()
        front = shared_checkpoint(reached.join(every, ["root", "node"], "left_anti"))
        if front.isEmpty():
            return every
        every = every.unionByName(front)


def reached_values(roots: DataFrame, edges: DataFrame, values: DataFrame) -> DataFrame:
    """(root, value): values (node, value) of all nodes that each root reaches.

    Values move against the edges, from a node to those that refer to it, so only pairs with a value are ever made; nodes without one below them cost nothing.
    """
    back = shared_checkpoint(edges.select(F.col("b").alias("node"), F.col("a").alias("user")).distinct())
    front = shared_checkpoint(values.select("node", "value").distinct())
    every = front
    while True:
        heard = front.join(back, "node").select(F.col("user").alias("node"), "value").distinct()
        front = shared_checkpoint(heard.join(every, ["node", "value"], "left_anti"))
        if front.isEmpty():
            return every.join(roots.select(F.col("root").alias("node")).distinct(), "node", "left_semi").withColumnRenamed("node", "root")
        every = every.unionByName(front)


#: Most edges that a task of ``searches`` holds (24 bytes an edge); starts of such a task, at least; words of 64 starts that are searched at once; edges that are followed at once.
LINKS, STARTS, WORDS, STEPS = 16_000_000, 2048, 8, 1 << 20


def _followed(front: np.ndarray, gain: np.ndarray, offsets: np.ndarray, to: np.ndarray, bits: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that the edges of ``front`` bring new starts to, and these: ``gain`` has the starts that came to ``front`` last, ``bits`` those that came to each node so far; ``fresh`` is room for them."""
    counts = offsets[front + 1] - offsets[front]
    parts = np.flatnonzero(np.diff(np.cumsum(counts) // STEPS)) + 1
    told = []
    for some, brought, n in zip(np.split(front, parts), np.split(gain, parts), np.split(counts, parts), strict=True):
        total = int(n.sum())
        if not total:
            continue
        edge = np.arange(total) + np.repeat(offsets[some] - np.cumsum(n) + n, n)
        order = np.argsort(to[edge], kind="stable")
        ends = to[edge][order]
        heads = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
        node = ends[heads]
        new = np.bitwise_or.reduceat(brought[np.repeat(np.arange(len(some)), n)[order]], heads, axis=0) & ~bits[node]
        more = new.any(axis=1)
        bits[node[more]] |= new[more]
        fresh[node[more]] |= new[more]
        told.append(node[more])
    front = np.unique(np.concatenate(told)) if told else front[:0]
    gain = fresh[front]
    fresh[front] = 0
    return front, gain


def _searched(starts: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """(label, n, found): the number of nodes that each label's starts reach, themselves included, and those of a negative number."""
    nodes, place = np.unique(np.concatenate([links["a"].to_numpy(), links["b"].to_numpy(), starts["node"].to_numpy()]), return_inverse=True)
    a, to, at = np.split(place, [len(links), 2 * len(links)])
    order = np.argsort(a, kind="stable")
    to, offsets = to[order], np.searchsorted(a[order], np.arange(len(nodes) + 1))
    labels, label = np.unique(starts["label"].to_numpy(dtype=object), return_inverse=True)
    asked = int(np.searchsorted(nodes, 0))
    bits, fresh = np.zeros((len(nodes), WORDS), np.uint64), np.zeros((len(nodes), WORDS), np.uint64)
    out = []
    for lo in range(0, len(labels), 64 * WORDS):
        own = (label >= lo) & (label < lo + 64 * WORDS)
        np.bitwise_or.at(bits, (at[own], (label[own] - lo) // 64), np.uint64(1) << ((label[own] - lo) % 64).astype(np.uint64))
        front = np.unique(at[own])
        gain = bits[front]
        while len(front):
            front, gain = _followed(front, gain, offsets, to, bits, fresh)
        some = labels[lo : lo + 64 * WORDS]

        def each(rows: np.ndarray, n: int = len(some)) -> np.ndarray:
            return np.unpackbits(rows.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :n]

        reached = np.flatnonzero(bits.any(axis=1))
        count = sum((each(bits[reached[k : k + 65536]]).sum(axis=0, dtype=np.int64) for k in range(0, len(reached), 65536)), np.zeros(len(some), np.int64))
        found = [nodes[:asked][hit != 0] for hit in each(bits[:asked]).T] if asked else [nodes[:0]] * len(some)
        out.append(pd.DataFrame({"label": some, "n": count, "found": found}))
        bits[reached] = 0
    return pd.concat(out) if out else pd.DataFrame({"label": [], "n": [], "found": []})


def searches(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(label, n, found) of the labels of starts (label, node) over directed edges (a, b) of numbered nodes: how many nodes they reach, and those of them with a negative number.

    All pairs of a label and a node it reaches are quadratic in the worst case and are not rows here: a task has a group of labels and all edges, and a bit for each node and label it searches for.
    """
    parallel = int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, min(parallel, -(-starts.count() // STARTS)))
    dealt = starts.select(F.pmod(F.xxhash64("label"), F.lit(groups)).alias("group"), "label", "node")
    everywhere = edges.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")).alias("group"), "a", "b")
    return dealt.groupBy("group").cogroup(everywhere.groupBy("group")).applyInPandas(_searched, "label string, n long, found array<long>")


def numbered(starts: DataFrame, edges: DataFrame, values: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Starts (label, node), edges (a, b) and values (node, value) with numbers for names: starts and edges as ``searches`` takes them, values (name, number) as nodes of negative numbers that what has them leads to."""
    names = starts.select("node").union(edges.select("a")).union(edges.select("b"))
    names = shared_checkpoint((names if values is None else names.union(values.select("node"))).distinct().select(F.col("node").alias("name"), F.monotonically_increasing_id().alias("id")))
    numbers = {c: names.select(F.col("name").alias(c), F.col("id").alias(f"{c}_id")) for c in ("node", "a", "b")}
    links = edges.join(numbers["a"], "a").join(numbers["b"], "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    named = None
    if values is not None:
        named = shared_checkpoint(values.select("value").distinct().select("value", (-F.monotonically_increasing_id() - 1).alias("number")))
        links = links.unionByName(values.join(numbers["node"], "node").join(named, "value").select(F.col("node_id").alias("a"), F.col("number").alias("b")))
    return shared_checkpoint(starts.join(numbers["node"], "node").select("label", F.col("node_id").alias("node")).distinct()), shared_checkpoint(links.distinct()), named


def reached_counts(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, n_reached): how many nodes ``closure`` finds for each root. Up to ``LINKS`` edges no pair of a root and a node is made."""
    starts, links, _ = numbered(roots.select(F.col("root").alias("label"), F.col("root").alias("node")), edges.select("a", "b"))
    if links.count() > LINKS:
        return closure(roots, edges).groupBy("root").agg(F.count("*").alias("n_reached"))
    return searches(starts, links).select(F.col("label").alias("root"), F.col("n").alias("n_reached"))


def labelled_values(starts: DataFrame, edges: DataFrame, values: DataFrame) -> DataFrame:
    """(label, value), each once: the values (node, value) of all nodes that the starts (label, node) of each label reach. Up to ``LINKS`` edges and values only these pairs are made."""
    asked, links, named = numbered(starts, edges.select("a", "b"), values)
    if links.count() > LINKS:
        found = reached_values(starts.select(F.col("node").alias("root")), edges, values)
        return starts.join(found.withColumnRenamed("root", "node"), "node").select("label", "value").distinct()
    pairs = searches(asked, links).select("label", F.explode("found").alias("number"))
    return pairs.join(named, "number").select("label", "value")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): least node linked to each node of undirected (a, b) edges, with labels that jump along labels each round."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).where("node <> near")
    both = shared_checkpoint(both.union(both.select("near", "node")).distinct())
    labels = shared_checkpoint(both.groupBy("node").agg(F.least(F.min("near"), F.col("node")).alias("root")))
    while True:
        heard = both.join(labels.withColumnRenamed("node", "near"), "near").groupBy("node").agg(F.min("root").alias("heard"))
        lower = labels.join(heard, "node").select("node", "root", F.least("root", "heard").alias("low"))
        jump = lower.select(F.col("node").alias("low"), F.col("low").alias("far"))
        step = shared_checkpoint(lower.join(jump, "low", "left").select("node", "root", F.coalesce(F.least("low", "far"), F.col("low")).alias("next")))
        labels = step.select("node", F.col("next").alias("root"))
        if step.where("next < root").isEmpty():
            return labels
