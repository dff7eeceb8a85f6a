"""SimHash near-duplicates: ball hashing that meets in the middle.

Two 64-bit fingerprints that differ in three bits or fewer have a value between them, one flip from one of them and two from the
other. So every distinct fingerprint emits the variants in its own half of the way, the variants are shuffled, and fingerprints that
meet at a variant are linked. Parity says which half is whose: fingerprints at an odd distance have different parities, so those with
an even number of ones emit their two-flip variants and those with an odd number the one-flip variants, and at distance two both
emit one flip. Of any three bits two lie in the same 32-bit half, so two-flip variants within a half are enough: 1,057 or 65 variants
a fingerprint.

Variants travel in packets: for each part of the variants' range, the fingerprints and the numbers of their flips. A part is one row
group of one task; it rebuilds its variants and sorts them, and fingerprints that share one are compared. All members of a variant's
bucket that lie one flip from it or less are within three bits of every other member; each member is linked to the least such one,
once the bits in which the two differ are counted. A bucket has at most 1 + 64 + 992 distinct fingerprints, whatever the input holds,
and its links are as many as its members, never all its pairs. Equal fingerprints are merged first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specgraph.llm.arrays import mix64
from specgraph.llm.common import checkpointed, linked_components, lookup

RADIUS = 3
_HASH = partial(xxhash.xxh64_intdigest, seed=42)
_ROWS = 1 << 15


def simhash(text: str | None, words: int = 3) -> int:
    """Majority bits of the hashes of all word shingles; no word gives 0, fewer words than ``words`` one shingle."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = zip(*(parts[i:] for i in range(words)), strict=False) if len(parts) >= words else [parts]
    hashes = np.fromiter(map(_HASH, map(b" ".join, shingles)), dtype="<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _ROWS):
        ones += np.unpackbits(hashes[lo : lo + _ROWS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """(key, fp long) of every row. A null text counts as empty; bytes.lower() and split() treat A-Z and ASCII white space only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([simhash(t.as_py(), words) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, fp long")


ONE = np.uint64(1) << np.arange(64, dtype=np.uint64)
TWO = np.array([(1 << i) | (1 << j) for half in (0, 32) for i, j in combinations(range(half, half + 32), 2)], dtype=np.uint64)


#: The flips by number: none, one (64), two within a half (992). Even fingerprints emit all, odd ones those of up to one flip.
FLIPS = np.concatenate([np.zeros(1, np.uint64), ONE, TWO])
ODD = 1 + len(ONE)
#: Variants that a part of the range is meant to hold, and fingerprints whose packets are made together; least parts and tasks. All go by the number of fingerprints alone.
IN_PART, TOGETHER, LEAST_PARTS, LEAST_TASKS = 1 << 19, 4096, 512, 32
_PACKED = np.dtype([("fp", "<u8"), ("flip", "<u2")])


def ball(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(variants, fingerprints, numbers of flips) that fingerprints emit."""
    odd = np.bitwise_count(fps) & 1 == 1
    out = []
    for own, n in ((fps[odd], ODD), (fps[~odd], len(FLIPS))):
        flips = np.arange(n, dtype=np.uint16)
        if n == ODD:
            flips = flips[1:]  # none of its partners' variants is an odd fingerprint itself
        out.append(((own[:, None] ^ FLIPS[flips]).reshape(-1), np.repeat(own, len(flips)), np.tile(flips, len(own))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def _packets(parts: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(every), TOGETHER):
                variants, fps, flips = ball(every[lo : lo + TOGETHER])
                part = ((mix64(variants) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
                order = np.argsort(part, kind="stable")
                packed = np.empty(len(order), _PACKED)
                packed["fp"], packed["flip"] = fps[order], flips[order]
                own, first = np.unique(part[order], return_index=True)
                raw, offs = pa.py_buffer(packed.tobytes()), np.append(first, len(order)) * _PACKED.itemsize
                rows = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(offs.astype(np.int32).tobytes()), raw])
                yield pa.RecordBatch.from_arrays([pa.array(own), rows], names=["part", "packet"])

    return run


def links_of(packets: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, hub) links of the fingerprints that meet at a variant of one part and differ in ``RADIUS`` bits at most, each once."""
    packed = np.frombuffer(b"".join(packets), _PACKED)
    fps, flips = packed["fp"], packed["flip"]
    variants = fps ^ FLIPS[flips]
    order = np.argsort(variants)
    variants = variants[order]
    same = np.append(variants[1:] == variants[:-1], False)
    meets = same.copy()
    meets[1:] |= same[:-1]
    at = order[meets]
    variants, fps, near = variants[meets], fps[at], flips[at] < ODD
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    group = np.cumsum(np.append(True, variants[1:] != variants[:-1])) - 1
    first = np.lexsort((fps, ~near, group))  # in each group the least fingerprint that is one flip away or less comes first
    heads = first[np.flatnonzero(np.append(True, group[first][1:] != group[first][:-1]))]
    hub = fps[heads][group]
    ok = near[heads][group] & (fps != hub)
    ok &= np.bitwise_count(fps ^ hub) <= RADIUS
    pairs = np.unique(np.stack([fps[ok], hub[ok]], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packets come by part."""
    part, held = None, []
    for batch in batches:
        for own, packet in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if own != part and held:
                yield _link_batch(held)
                held = []
            part = own
            held.append(packet)
    if held:
        yield _link_batch(held)


def _link_batch(packets: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in links_of(packets)], names=["fp", "hub"])


def near_links(distinct_fps: DataFrame, fp: str = "fp") -> DataFrame:
    """(fp, hub): links between distinct fingerprints at most three bits apart whose components are those of all such pairs.

    ``distinct_fps`` is read twice, so it should be a written table.
    """
    n = distinct_fps.count()
    parts = min(1 << 20, max(LEAST_PARTS, -(-n * 561 // IN_PART)))
    # few bytes, but hundreds of variants come from each: an even deal over all tasks, whatever their bytes suggest
    dealt = distinct_fps.select(fp).repartition(max(LEAST_TASKS, -(-n // TOGETHER)), fp)
    packets = dealt.mapInArrow(_packets(parts), "part int, packet binary")
    by_part = packets.repartition(parts // 8, "part").sortWithinPartitions("part")
    return by_part.mapInArrow(_linked, "fp long, hub long").distinct()


def near_components(fps: DataFrame) -> DataFrame:
    """Adds component_id, the least key reachable over links of at most three bits, to (key, fp).

    Equal fingerprints, 0 among them, are one node. ``fps`` is read several times, so it should be a written table. A null key is kept and never names a component unless no other key is there.
    """
    nodes = checkpointed(fps.groupBy("fp").agg(F.min("key").alias("least")))
    roots = linked_components(near_links(nodes), "fp", "hub").withColumnRenamed("node", "fp")
    named = checkpointed(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = lookup(named.select("fp", "root"), ids, "root").select("fp", "component_id")
    return lookup(fps, checkpointed(by_fp), "fp")


def hex16(fp: Column) -> Column:
    """A long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) of every row.

    Null and empty texts have fingerprint 0 and link like any other. Repeated keys keep a row each. Other columns are not read.
    An empty table gives an empty table.
    """
    fps = checkpointed(fingerprints(docs, key, text))
    out = near_components(fps)
    return out.select(F.col("key").alias(key), hex16(F.col("fp")).alias("fingerprint"), "component_id")
