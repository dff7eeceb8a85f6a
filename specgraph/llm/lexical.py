"""Ranked lexical search by pipelined term partitioning.

Terms are dealt to owners, the rarest to the first and the commonest to the last. An owner holds the postings of its terms, cut into blocks of
documents so that no task holds a common term's whole list. A bundle is an item's terms and weights with an accumulator of scores for the
documents of one block that hold any of them; bundles pass through the owners in order, each owner a cogroup with its postings by block, and
each adds whole-number contributions. The last owner's stage selects.

After each owner a bundle drops the documents that can no longer be among the best of their block: those whose score, with the most that
later owners can add, is below the score that ``TOP`` documents have already. Nothing that could be selected is dropped.

Two fixed tables of 2 ** ``SLOT_BITS`` slots, addressed by first bits of a term's hash, go to all machines: which slots hold terms of items,
and who owns them. Terms that share a slot share an owner; a larger benchmark lets more terms of documents through, never fewer. A term is
known by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specgraph.llm.arrays import Words, mix64, text_buffers
from specgraph.llm.common import checkpointed, scratch_path

U64 = np.uint64
TOP, SLOT_BITS = 20, 20
#: Share of all documents up to which a slot's documents make it owner 0, 1, ...; the last owner has the rest.
OWNERS = (1 / 1024, 1 / 64, 1 / 8)
#: Documents in a block on average, most documents and bytes of a packet of postings, and parts of the first selection.
BLOCK, PACKET, PACKET_BYTES, PARTS = 2048, 128, 2 << 20, 64
#: Entries that a task counts before it sends them on.
FLUSH = 1 << 22
#: More than any document adds for a term of weight 1.
MOST = 1_000_000
BUNDLE = "item_id long, block long, owners binary, terms binary, weights binary, places binary, scores binary"
FOUND = "item_id long, block long, doc_id long, score long"


def slot(terms: np.ndarray) -> np.ndarray:
    return (terms >> U64(64 - SLOT_BITS)).astype(np.int64)


def packets(offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``PACKET`` rows and about ``PACKET_BYTES``; one long row is a range of its own."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = min(n, lo + PACKET, max(lo + 1, int(np.searchsorted(offs, offs[lo] + PACKET_BYTES, "right")) - 1))
        yield lo, hi
        lo = hi


def counted_terms(words: Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, times) of each row's terms whose slot is ``known``, by row and term."""
    some = np.flatnonzero(known[slot(words.hashes)])
    row, term = words.rows()[some], words.hashes[some]
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (term[1:] != term[:-1]))) if len(row) else np.zeros(0, np.int64)
    return row[first], term[first], np.diff(np.append(first, len(row)))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = Words(*text_buffers(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(words.rows())), pa.array(words.hashes.view(np.int64))], names=["item_id", "term"])


def item_terms(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, term, times): terms of each item with repeats."""
    texts = benchmark.select(F.col(item).cast("long").alias("item_id"), F.col(text).alias("text")).where("text is not null").distinct()
    return texts.mapInArrow(_item_terms, "item_id long, term long").groupBy("item_id", "term").agg(F.count("*").alias("times"))


def slots(rows: DataFrame, value: str) -> np.ndarray:
    """One byte for each slot: the greatest ``value`` (1 to 255) of its rows, 0 where there are none; 2 ** ``SLOT_BITS`` rows at most reach the driver."""
    found = rows.groupBy(F.shiftrightunsigned("term", 64 - SLOT_BITS).cast("int").alias("slot")).agg(F.max(F.expr(value)).cast("int").alias("value")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.uint8)
    out[found.column("slot").to_numpy()] = found.column("value").to_numpy()
    return out


def term_counts(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """(term, docs, words, rows): documents of each term of a known slot; the row without a term has all documents with a term, their terms and all rows."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size, totals = [], 0, np.zeros(3, np.int64)

        def flushed() -> pa.RecordBatch:
            terms, times = np.unique(np.concatenate([np.zeros(0, U64), *kept]), return_counts=True)
            zero = pa.array(np.zeros(len(terms), np.int64))
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(times), zero, zero], names=["term", "docs", "words", "rows"])

        for batch in batches:
            buf, offs = text_buffers(batch.column(0))
            for lo, hi in packets(offs):
                words = Words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                n = np.diff(words.bounds)
                totals += ((n > 0).sum(), n.sum(), hi - lo)
                kept.append(counted_terms(words, held.value)[1])
                size += len(kept[-1])
                if size > FLUSH:
                    yield flushed()
                    kept, size = [], 0
        yield flushed()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), *(pa.array([t]) for t in totals)], names=["term", "docs", "words", "rows"])

    return docs.select("text").mapInArrow(run, "term long, docs long, words long, rows long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("docs", "words", "rows")))


def postings(docs: DataFrame, owner_of: np.ndarray, n_docs: int, n_words: int, blocks: int) -> DataFrame:
    """(owner, block, packet, doc_ids, places, terms, parts): for each packet of documents and each owner, what a document adds for a term of weight 1, and every document's id."""
    held = docs.sparkSession.sparkContext.broadcast(owner_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            for lo, hi in packets(offs):
                words = Words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                row, term, times = counted_terms(words, held.value)
                norm = 75 + 25 * np.diff(words.bounds) * n_docs // n_words
                part = (1_000_000_000 * times) // (1000 * times + 12 * norm[row])
                owner = held.value[slot(term)] - 1
                packet = (task << 32) + k
                block = int(mix64(np.array([packet], U64))[0] % U64(blocks))
                k += 1
                mine = [owner == o for o in range(len(OWNERS) + 1)]
                packed = [pa.array([x[m].astype(kind).tobytes() for m in mine], pa.binary()) for x, kind in ((row, np.int32), (term, U64), (part, np.int32))]
                ids = pa.ListArray.from_arrays(pa.array(np.arange(len(mine) + 1, dtype=np.int32) * (hi - lo)), pa.concat_arrays([batch.column(0).slice(lo, hi - lo)] * len(mine)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(mine)), pa.int32()), pa.array([block] * len(mine)), pa.array([packet] * len(mine)), ids, *packed], names=["owner", "block", "packet", "doc_ids", "places", "terms", "parts"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, "owner int, block long, packet long, doc_ids array<long>, places binary, terms binary, parts binary")


class Block:
    """Postings of one owner for the documents of one block: documents in the order of their packets, postings in the order of their terms."""

    def __init__(self, table: pa.Table):
        table = table.sort_by("packet")
        ids = table.column("doc_ids").combine_chunks()
        sizes = np.diff(ids.offsets.to_numpy()) if len(ids) else np.zeros(0, np.int64)
        flat = ids.flatten()
        self.doc_ids = flat
        first = np.append(0, np.cumsum(sizes))
        rows, terms, parts = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_py(), kind) for x in table.column(c))]) for c, kind in (("places", np.int32), ("terms", U64), ("parts", np.int32)))
        packet = np.repeat(np.arange(len(sizes)), [len(x.as_py()) // 4 for x in table.column("places")])
        order = np.argsort(terms, kind="stable")
        self.terms, self.places, self.parts = terms[order], (rows + first[packet])[order], parts[order].astype(np.int64)

    def add(self, scores: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        lo, hi = np.searchsorted(self.terms, terms, "left"), np.searchsorted(self.terms, terms, "right")
        for a, b, w in zip(lo.tolist(), hi.tolist(), weights.tolist(), strict=True):
            scores[self.places[a:b]] += w * self.parts[a:b]  # a document has a term once


def best(scores: np.ndarray, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The ``TOP`` of ``places`` with the highest scores; equal scores by ascending id."""
    if len(places) > TOP:
        least = np.partition(scores[places], -TOP)[-TOP]
        places = places[scores[places] >= least]
    return places[np.lexsort((ids[places], -scores[places]))[:TOP]]


def stage(owner: int, last: bool):  # noqa: ANN201
    """What one owner does with the bundles and the postings of a block."""

    def run(bundles: pa.Table, lists: pa.Table) -> pa.Table:
        block = Block(lists)
        n = len(block.doc_ids)
        ids = block.doc_ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        places_out, scores_out, found = [], [], []
        for i in range(bundles.num_rows):
            owners, terms, weights, places, before = (np.frombuffer(bundles.column(c)[i].as_py(), kind) for c, kind in (("owners", np.uint8), ("terms", U64), ("weights", np.int64), ("places", np.int32), ("scores", np.int64)))
            scores = np.zeros(n, np.int64)
            scores[places] = before
            mine = owners == owner
            block.add(scores, terms[mine], weights[mine])
            held = np.flatnonzero(scores)
            if last:
                at = best(scores, ids, held)
                found.append((np.full(len(at), i), at, scores[at]))
                continue
            to_come = int(weights[owners > owner].sum()) * MOST
            if len(held) > TOP:
                held = held[scores[held] + to_come >= np.partition(scores[held], -TOP)[-TOP]]
            places_out.append(held.astype(np.int32).tobytes())
            scores_out.append(scores[held].tobytes())
        if not last:
            kept = bundles.select(["item_id", "block", "owners", "terms", "weights"])
            return kept.append_column("places", pa.array(places_out, pa.binary())).append_column("scores", pa.array(scores_out, pa.binary()))
        rows, at, score = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        take = pa.array(rows)
        return pa.table({"item_id": bundles.column("item_id").take(take), "block": bundles.column("block").take(take), "doc_id": block.doc_ids.take(pa.array(at)), "score": pa.array(score)})

    return run


def _bundled(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        packed = [pa.array([np.array(x.as_py(), kind).tobytes() for x in batch.column(c)], pa.binary()) for c, kind in (("owners", np.uint8), ("terms", np.int64), ("weights", np.int64))]
        none = pa.array([b""] * batch.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("block"), *packed, none, none], names=["item_id", "block", "owners", "terms", "weights", "places", "scores"])


def ranked(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``TOP`` best rows of ``docs``.

    A null or empty text has no terms. Rows of ``docs`` that are repeated are each ranked; rows without an id come first among equal scores.
    Repeated rows of the benchmark count once; other texts of one item id are one item with all their terms. Items without a term that a
    document has, and empty tables, give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    asked = checkpointed(item_terms(benchmark, item, item_text))
    counts = checkpointed(term_counts(docs, slots(asked, "1")))
    whole = counts.where("term is null").first()
    n_docs, n_words, rows = (whole["docs"], whole["words"], whole["rows"]) if whole else (0, 0, 0)
    if not n_docs:
        return asked.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    share = F.sum("docs").over(Window.partitionBy(F.shiftrightunsigned("term", 64 - SLOT_BITS))) / n_docs
    owner = F.lit(len(OWNERS))
    for o in reversed(range(len(OWNERS))):
        owner = F.when(share <= OWNERS[o], o).otherwise(owner)
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("docs") + 1)))
    known = counts.join(asked.select("term").distinct(), "term").select("term", weight.cast("long").alias("weight"), owner.alias("owner"))
    known = checkpointed(known)
    blocks = -(-rows // BLOCK)
    path = scratch_path(spark, "postings")
    postings(docs, slots(known, "owner + 1"), n_docs, n_words, blocks).write.partitionBy("owner").parquet(path)
    terms = F.struct("owner", "term", (F.col("weight") * F.col("times")).alias("weight"))
    bundles = asked.join(known, "term").groupBy("item_id").agg(F.collect_list(terms).alias("t"))
    bundles = bundles.select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.col("t.owner").alias("owners"), F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"))
    bundles = bundles.mapInArrow(_bundled, BUNDLE)
    schema = "owner int, block long, packet long, doc_ids array<long>, places binary, terms binary, parts binary"
    for o in range(len(OWNERS) + 1):
        lists = spark.read.schema(schema).parquet(path).where(F.col("owner") == o).drop("owner")
        last = o == len(OWNERS)
        bundles = bundles.groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(stage(o, last), FOUND if last else BUNDLE)
    order = (F.desc("score"), F.asc("doc_id"))
    first = bundles.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", F.pmod("block", F.lit(PARTS))).orderBy(*order))).where(F.col("rank") <= TOP)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= TOP).select("item_id", "rank", "doc_id", "score")
