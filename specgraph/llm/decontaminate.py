"""Benchmark decontamination by spaced-seed hashing.

A mask keeps some token positions of a window and ignores the others, so a window whose substituted tokens fall on ignored
positions hashes like the original. Every window of every text, under every mask, is hashed, and so is every window of the benchmark
items; texts and items that share a hash are joined on it. A hit fixes how text and item lie on each other; the tokens around it are
then compared one by one, and the longest stretch in which enough tokens agree is an overlap if it is long enough.

Most windows of a text are in no item. A Bloom filter of the items' hashes, of 2 ** ``MOST_BITS`` bits at most, keeps them from the
shuffle; a benchmark too large for it lets more windows through, never fewer. Equal texts are joined once, and hashes that many texts share
are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgraph.llm.arrays import Words, from_texts, mix64, row_chunks, text_buffers
from specgraph.llm.common import checkpointed, lookup, spread_join

U64 = np.uint64
#: Weight 6: the chance that a window with a fifth of its tokens substituted still hits is 0.26 for each place and mask.
MASKS = ("111111", "1101100011", "11010010011", "110010100101")
#: Shortest overlap in tokens (an item of fewer tokens must lie in the text whole) and least share of agreeing tokens in it.
MIN_TOKENS, MIN_SHARE = 12, 0.8
#: Size of the filter (16 MB; about 64 to 128 bits for each window of a smaller benchmark), bits in one of its pages, and bits that a window sets.
MOST_BITS, PAGE_BITS = 27, 15
TURNS = (1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)
#: Most rows that are sent to all machines; more are joined by key.
FEW = 1_000_000
SCHEMA = "doc_id long, item_id long, first_token long, n_tokens long, n_equal long, item_tokens long"
_PLACE = mix64(np.arange(1, 65, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def seed_hashes(tokens: np.ndarray, mask: str) -> np.ndarray:
    """Hash of every window under a mask; the last ones, which do not fit, are left out."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for i, kept in enumerate(mask):
            if kept == "1":
                out += tokens[i : i + n] * _PLACE[i % 64]
        return mix64(out ^ U64(len(mask)))


def all_masks(short: list[int]) -> list[str]:
    """The masks, and one of full length for each item length that is shorter than the longest mask."""
    return [*MASKS, *("1" * n for n in sorted(short) if "1" * n not in MASKS)]


def seeds(tokens: np.ndarray, bounds: np.ndarray, masks: list[str], whole: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every window that lies in one row; ``whole``: masks of full length only for rows of that length."""
    ends, lens = bounds[1:], np.diff(bounds)
    row_of = np.repeat(np.arange(len(lens)), lens)
    out, rows = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for m, mask in enumerate(masks):
        h = seed_hashes(tokens, mask)
        own = row_of[: len(h)]
        ok = np.arange(len(h)) + len(mask) <= ends[own] if len(h) else np.zeros(0, dtype=bool)
        if whole and m >= len(MASKS):
            ok &= lens[own] == len(mask)
        out.append(h[ok])
        rows.append(own[ok])
    return np.concatenate(out), np.concatenate(rows)


def shifts(text: np.ndarray, item: np.ndarray, masks: list[str]) -> np.ndarray:
    """Every shift (place in the text less place in the item) at which a window of both has the same hash. Memory is linear in both, however often a window repeats."""
    seen = np.zeros(len(text) + len(item) + 1, dtype=bool)
    for m, mask in enumerate(masks):
        if m >= len(MASKS) and len(mask) != len(item):
            continue
        a, b = seed_hashes(text, mask), seed_hashes(item, mask)
        order = np.argsort(a, kind="stable")
        values, inverse, times = np.unique(b, return_inverse=True, return_counts=True)
        lo, hi = np.searchsorted(a[order], values, "left"), np.searchsorted(a[order], values, "right")
        places = np.argsort(inverse, kind="stable")
        ends = np.cumsum(times)
        for k in np.flatnonzero(hi > lo).tolist():
            here, there = order[lo[k] : hi[k]], places[ends[k] - times[k] : ends[k]]
            fewer, more, sign = (there, here, -1) if len(there) <= len(here) else (here, there, 1)
            for p in fewer.tolist():
                seen[(more - p if sign < 0 else p - more) + len(item)] = True
    return np.flatnonzero(seen) - len(item)


def best_overlap(text: np.ndarray, item: np.ndarray, masks: list[str]) -> tuple[int, int, int, int] | None:
    """(first token, tokens, equal tokens, item's tokens) of the overlap with most equal tokens, then the first; None if none is long enough."""
    best = None
    for d in shifts(text, item, masks).tolist():
        lo, hi = max(0, d), min(len(text), d + len(item))
        if hi - lo < min(MIN_TOKENS, len(item)) or (best is not None and hi - lo <= best[2]):
            continue
        equal = text[lo:hi] == item[lo - d : hi - d]
        a, b = longest_stretch(equal)
        same = int(equal[a:b].sum())
        if b - a >= min(MIN_TOKENS, len(item)) and (best is None or same > best[2] or (same == best[2] and lo + a < best[0])):
            best = (lo + a, b - a, same, len(item))
    return best


def longest_stretch(equal: np.ndarray) -> tuple[int, int]:
    """The longest stretch with a share of ``MIN_SHARE`` equal at least; of those the one with most equal, then the first. Whole percents keep the sums exact."""
    score = np.zeros(len(equal) + 1, np.int64)
    np.cumsum(np.where(equal, 100, 0) - round(100 * MIN_SHARE), out=score[1:])
    least = np.minimum.accumulate(score)
    starts = np.searchsorted(-least, -score, "left")  # for each end the first place whose sum is no greater
    n = np.arange(len(score)) - starts
    ends = np.flatnonzero(n == n.max())
    end = int(ends[np.argmax(score[ends] - score[starts[ends]])])
    return int(starts[end]), end


def _item_windows(masks: list[str]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column(2))
            for lo, hi in row_chunks(offs):
                words = Words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                h, row = seeds(words.hashes, words.bounds, masks, True)
                at = pa.array(lo + row)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], names=["hash", "i1", "i2"])

    return run


def filter_bits(hashes: np.ndarray, turn: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes * U64(turn)) >> U64(64 - bits)).astype(np.int64)


def window_filter(windows: DataFrame) -> tuple[bytes, int]:
    """The filter's bits, and how many first bits of a turned hash say which. Pages are made by Spark; their bytes together are bounded."""
    bits = min(MOST_BITS, max(PAGE_BITS, int(windows.count() * 64).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
            for turn in TURNS:
                at = np.unique(filter_bits(h, turn, bits))
                yield pa.RecordBatch.from_arrays([pa.array((at >> PAGE_BITS).astype(np.int32)), pa.array((at & ((1 << PAGE_BITS) - 1)).astype(np.int32))], names=["page", "bit"])

    pages = windows.select("hash").mapInArrow(run, "page int, bit int").groupBy("page").agg(F.collect_set("bit").alias("bits"))
    table = np.zeros(1 << bits, dtype=bool).reshape(-1, 1 << PAGE_BITS)
    for row in pages.toLocalIterator():
        table[row["page"], row["bits"]] = True
    return np.packbits(table.reshape(-1), bitorder="little").tobytes(), bits


def text_key(column: str) -> list:
    """Two hashes, 128 bits together, that stand for a text."""
    return [F.xxhash64(column).alias("t1"), F.xxhash64(F.lit("text"), column).alias("t2")]


def found_texts(texts: DataFrame, benchmark: DataFrame, item: str, item_text: str) -> DataFrame:
    """(t1, t2, item, first_token, n_tokens, n_equal, item_tokens): the best overlap of each distinct text of ``texts`` (column text) and each item that have one."""
    items = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).where("text is not null and text <> ''").distinct()
    items = checkpointed(items.select(F.xxhash64("text", "item").alias("i1"), F.xxhash64(F.lit("item"), "text", "item").alias("i2"), "text", "item"))
    sizes = items.select("text").mapInArrow(_token_counts, "n int").where(f"n between 1 and {max(map(len, MASKS)) - 1}").distinct()
    masks = all_masks([r["n"] for r in sizes.collect()])  # at most as many as the longest mask has positions
    windows = checkpointed(items.select("i1", "i2", "text").mapInArrow(_item_windows(masks), "hash long, i1 long, i2 long").distinct())
    table = texts.sparkSession.sparkContext.broadcast(window_filter(windows))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, bits = table.value
        flags = np.frombuffer(raw, np.uint8)
        for batch in batches:
            buf, offs = text_buffers(batch.column(2))
            for lo, hi in row_chunks(offs):
                words = Words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                h, row = seeds(words.hashes, words.bounds, masks)
                some = np.arange(len(h))
                for turn in TURNS:
                    at = filter_bits(h[some], turn, bits)
                    some = some[(flags[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
                if not len(some):
                    continue
                order = some[np.argsort(row[some], kind="stable")]
                rows, first = np.unique(row[order], return_index=True)
                ends = np.append(first, len(order)).astype(np.int32)
                tokens = [words.hashes[words.bounds[r] : words.bounds[r + 1]].tobytes() for r in rows.tolist()]
                hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(h[order].view(np.int64)))
                take = pa.array(lo + rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(tokens, pa.binary()), hashes], names=["t1", "t2", "tokens", "hashes"])

    held = texts.select(*text_key("text"), "text").mapInArrow(candidates, "t1 long, t2 long, tokens binary, hashes array<long>")
    held = checkpointed(held.groupBy("t1", "t2").agg(F.first("tokens").alias("tokens"), F.first("hashes").alias("hashes")))
    seen = checkpointed(held.select("t1", "t2", F.explode(F.array_distinct("hashes")).alias("hash")))
    pairs = checkpointed(spread_join(seen, windows, "hash").select("t1", "t2", "i1", "i2").distinct())
    with_items = lookup(pairs, items.mapInArrow(_item_tokens, "i1 long, i2 long, item long, item_words binary"), "i1", "i2")
    both = with_items.join(held.select("t1", "t2", "tokens"), ["t1", "t2"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, values = [], []
            for i in range(batch.num_rows):
                text, words = (np.frombuffer(batch.column(k)[i].as_py(), U64) for k in (3, 4))
                got = best_overlap(text, words, masks)
                if got is not None:
                    keep.append(i)
                    values.append(got)
            if keep:
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), *(pa.array(x, pa.int64()) for x in zip(*values, strict=True))], names=["t1", "t2", "item", "first_token", "n_tokens", "n_equal", "item_tokens"])

    return both.select("t1", "t2", "item", "tokens", "item_words").mapInArrow(verified, "t1 long, t2 long, item long, first_token long, n_tokens long, n_equal long, item_tokens long")


def _token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.diff(Words(*text_buffers(batch.column(0))).bounds).astype(np.int32))], names=["n"])


def _item_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = Words(*text_buffers(batch.column(2)))
        tokens = [words.hashes[a:b].tobytes() for a, b in zip(words.bounds, words.bounds[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(tokens, pa.binary())], names=["i1", "i2", "item", "item_words"])


def overlapping(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_token, n_tokens, n_equal, item_tokens): the best overlap of each document row and benchmark item that have one.

    Null and empty texts overlap nothing, on either side. A null item id is given as -1. Repeated items give a row each (rows of one item id and text are merged);
    repeated documents too. Other columns are not read. An empty table on either side gives an empty table.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    found = checkpointed(found_texts(rows, benchmark, item, item_text))
    named = spread_join(_of_found(rows.select("doc_id", *text_key("text")), found), found, "t1", "t2")
    return named.select("doc_id", F.coalesce("item", F.lit(-1)).alias("item_id"), "first_token", "n_tokens", "n_equal", "item_tokens")


def _of_found(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows whose text is among those found, as a written table; where those are ``FEW`` they are sent to all machines."""
    texts = found.select("t1", "t2").distinct()
    texts = F.broadcast(texts) if texts.limit(FEW + 1).count() <= FEW else texts
    return checkpointed(rows.join(texts, ["t1", "t2"], "left_semi"))


def without_overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows, with all their columns, that overlap no benchmark item."""
    texts = checkpointed(found_texts(docs.select(F.col(text).alias("text")), benchmark, item, item_text).select("t1", "t2").distinct())
    texts = F.broadcast(texts) if texts.limit(FEW + 1).count() <= FEW else texts
    t1, t2 = text_key(text)
    # names of its own, so that no column of the documents is hidden
    own = texts.select(F.col("t1").alias("_t1"), F.col("t2").alias("_t2"))
    return docs.join(own, (F.xxhash64(text) == F.col("_t1")) & (F.xxhash64(F.lit("text"), text) == F.col("_t2")), "left_anti")
