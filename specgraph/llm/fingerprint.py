"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A digest stands for a paragraph: a line, or, of a longer line, the words from one content-given cut to the next. A line is cut before
a word if a hash of that word and the one before says so, once in ``RUN`` times, so an insertion changes the paragraph it falls in and
leaves the others as they are. A sketch has cells of (count, sum of digests, sum of digest checks); a digest is added to one cell in
each of three parts. Subtracting two sketches cancels what the texts share, and peeling cells that hold one digest recovers the digests
that only one of them has. The stored sketch is small (``CELLS`` cells in each part) and is tried first; where the difference does not
peel, both sides are sketched again four times as large, as often as needed, from the digests. Likeness is the Jaccard index of the
digest sets that the recovered difference implies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgraph.llm.arrays import BYTE_CODES, NON_SPACE, Words, from_texts, mix64, row_chunks

RUN = 4
CELLS = 8
GROWTH = 4
U64 = np.uint64
_CHECK, _PAIR = U64(0xC2B2AE3D27D4EB4F), U64(0x9E3779B97F4A7C15)


class DigestSets:
    """Distinct paragraph digests of some texts: keys of text i are keys[bounds[i]:bounds[i + 1]], ascending."""

    def __init__(self, texts: list[bytes], run: int = RUN):
        buf, offs = from_texts(texts)
        w = Words(buf, offs, NON_SPACE, BYTE_CODES)
        n, rows = len(w.starts), w.rows()
        lines = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(buf == 10, out=lines[1:])
        line = lines[w.starts]
        new = np.ones(n, dtype=bool)
        new[1:] = (line[1:] != line[:-1]) | (rows[1:] != rows[:-1])
        with np.errstate(over="ignore"):
            new[1:] |= mix64(w.hashes[:-1] * _PAIR + w.hashes[1:]) % U64(run) == 0
            at = np.flatnonzero(new)
            place = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
            coded = w.hashes * (mix64(place.astype(U64) + U64(77)) | U64(1))
            keys = mix64(np.add.reduceat(coded, at)) if n else np.zeros(0, U64)
        rows = rows[at] if n else np.zeros(0, np.int64)
        order = np.argsort(keys, kind="stable")
        order = order[np.argsort(rows[order], kind="stable")]
        keys, rows = keys[order], rows[order]
        fresh = np.ones(len(keys), dtype=bool)
        fresh[1:] = (keys[1:] != keys[:-1]) | (rows[1:] != rows[:-1])
        self.keys = keys[fresh]
        self.bounds = np.searchsorted(rows[fresh], np.arange(len(texts) + 1))
        self.counts = np.diff(self.bounds)

    def of(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the chosen texts and, for each key, the place of its text among those chosen."""
        counts = self.counts[which]
        rows = np.repeat(np.arange(len(which)), counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(self.bounds[which], counts)
        return self.keys[at], rows


class Sketches:
    """Sketches of ``n`` texts at one size, as arrays of shape (n, 3, part)."""

    def __init__(self, n: int, level: int):
        self.n, self.level, self.part = n, level, CELLS * GROWTH**level
        self.count, self.key, self.check = np.zeros(n * 3 * self.part, np.int64), np.zeros(n * 3 * self.part, U64), np.zeros(n * 3 * self.part, U64)

    def cells(self, keys: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
        mixed = mix64(keys ^ U64(0x51ED270B * (self.level + 1)))
        for j in range(3):
            yield (rows * 3 + j) * self.part + ((mixed >> U64(21 * j)) & U64(self.part - 1)).astype(np.int64)

    def add(self, keys: np.ndarray, rows: np.ndarray, sign: np.ndarray | int = 1) -> None:
        sign = np.broadcast_to(np.asarray(sign, np.int64), keys.shape)
        with np.errstate(over="ignore"):
            turned = sign.astype(U64)
            signed, checks = keys * turned, mix64(keys * _CHECK) * turned
        for at in self.cells(keys, rows):
            np.add.at(self.count, at, sign)
            np.add.at(self.key, at, signed)
            np.add.at(self.check, at, checks)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(0, self.level)
        out.n = self.n
        with np.errstate(over="ignore"):
            out.count, out.key, out.check = self.count - other.count, self.key - other.key, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Empties a difference: (digests, their texts, +1 or -1 for the side that has them, whether each text came out whole)."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        look = np.flatnonzero(np.abs(self.count) == 1)
        while len(look):
            sign = self.count[look]
            with np.errstate(over="ignore"):
                keys = self.key[look] * sign.astype(U64)
                good = (np.abs(sign) == 1) & (mix64(keys * _CHECK) * sign.astype(U64) == self.check[look])
            keys, sign, rows = keys[good], sign[good], look[good] // (3 * self.part)
            if not len(keys):
                break
            _, once = np.unique(keys ^ mix64(rows.astype(U64)), return_index=True)
            keys, sign, rows = keys[once], sign[once], rows[once]
            found.append((keys, rows, sign))
            self.add(keys, rows, -sign)
            touched = np.unique(np.concatenate(list(self.cells(keys, rows))))
            look = touched[np.abs(self.count[touched]) == 1]
        left = ((self.count != 0) | (self.key != 0) | (self.check != 0)).reshape(self.n, -1).any(axis=1)
        parts = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        return *parts, ~left

    def chosen(self, which: slice) -> Sketches:
        """The sketches of some of the texts."""
        rows = range(self.n)[which]
        out = Sketches(0, self.level)
        out.n = len(rows)
        size = 3 * self.part
        out.count, out.key, out.check = (x[rows.start * size : rows.stop * size] for x in (self.count, self.key, self.check))
        return out

    def texts(self, counts: np.ndarray) -> list[str]:
        """Each sketch as text: number of digests, then cells as hex (16-bit count, 64-bit sum, 32-bit check)."""
        cell = np.zeros((self.n, 3 * self.part), dtype=np.dtype([("c", ">u2"), ("k", ">u8"), ("h", ">u4")]))
        cell["c"], cell["k"], cell["h"] = (x.reshape(self.n, -1) for x in (self.count & 0xFFFF, self.key, self.check >> U64(32)))
        raw, size = cell.tobytes().hex(), 3 * self.part * 28
        return [f"{c:x}:{raw[i * size : (i + 1) * size]}" for i, c in enumerate(counts.tolist())]


def sketch(sets: DigestSets, which: np.ndarray, level: int = 0) -> Sketches:
    out = Sketches(len(which), level)
    out.add(*sets.of(which))
    return out


def differences(a: DigestSets, ia: np.ndarray, b: DigestSets, ib: np.ndarray, first: tuple[Sketches, Sketches] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """How many digests only text ia[i] of ``a`` has and only ib[i] of ``b``, by subtraction and peeling; ``first`` has the stored sketches of both."""
    only_a, only_b, todo, level = np.zeros(len(ia), np.int64), np.zeros(len(ia), np.int64), np.arange(len(ia)), 0
    while len(todo):
        x, y = first if first is not None and not level else (sketch(a, ia[todo], level), sketch(b, ib[todo], level))
        _, rows, sign, whole = x.minus(y).peel()
        plus, minus = np.bincount(rows[sign > 0], minlength=len(todo)), np.bincount(rows[sign < 0], minlength=len(todo))
        only_a[todo[whole]], only_b[todo[whole]] = plus[whole], minus[whole]
        todo, level = todo[~whole], level + 1
    return only_a, only_b


def likeness(a: DigestSets, ia: np.ndarray, b: DigestSets, ib: np.ndarray, first: tuple[Sketches, Sketches] | None = None) -> np.ndarray:
    """Jaccard index of two digest sets; 1 if both are empty."""
    only_a, only_b = differences(a, ia, b, ib, first)
    both = a.counts[ia] - only_a
    union = both + only_a + only_b
    return np.where(union > 0, both / np.maximum(union, 1), 1.0)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many code points from the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_digests long"


def _compare(ids: list, texts: list[str], following: str) -> pa.RecordBatch:
    """Rows for consecutive documents; ``following`` is the text after the last."""
    changed = [edited(t, x).encode() for t, x in zip(texts, [*texts[1:], following], strict=True)]
    raw = [t.encode() for t in [*texts, following]]
    own, edits, every = DigestSets(raw), DigestSets(changed), np.arange(len(texts))
    stored, of_edits = sketch(own, np.arange(len(raw))), sketch(edits, every)
    here, following_ones = stored.chosen(slice(0, -1)), stored.chosen(slice(1, None))
    values = [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in changed]),
        pa.array(here.texts(own.counts[:-1])), pa.array(of_edits.texts(edits.counts)),
        pa.array(likeness(own, every, edits, every, (here, of_edits))), pa.array(likeness(own, every, own, every + 1, (here, following_ones))), pa.array(own.counts[:-1]),
    ]
    return pa.RecordBatch.from_arrays(values, names=[x.split()[0] for x in SCHEMA.split(", ")])


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by (bucket, guest, doc_id, text); a bucket ends in its guest, the first document of the next one."""
    ids: list = []
    texts: list[str] = []
    size = 0
    for batch in batches:
        for guest, i, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            text = text or ""
            if texts and (guest or size > 2 << 20):
                yield _compare(ids, texts, text)
                ids, texts, size = [], [], 0
            if not guest:
                ids.append(i)
                texts.append(text)
                size += len(text)
    if texts:
        raise ValueError("a bucket without its last row")


#: Rows a bucket is meant to hold, and the most buckets (their bounds and first rows are all that meets in one place).
ROWS_IN_BUCKET, MOST_BUCKETS = 200, 10_000


def with_following(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(bucket, guest, key, h, text): buckets are ranges of the key, and each has as its guest the first row of the next one.

    The last bucket's guest is the first row of all. Order is by key, nulls first, then a hash of the text, then the text. The rows of
    a key that a thousandth of the rows have, null among them, are cut into ranges of that hash.
    """
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    parts = min(MOST_BUCKETS, docs.count() // ROWS_IN_BUCKET)
    cuts = docs.approxQuantile("key", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    common = {r["key"]: r["n"] for r in docs.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") * 1000 > parts * ROWS_IN_BUCKET).where(F.col("n") > ROWS_IN_BUCKET).collect()}
    hot = np.array(sorted(k for k in common if k is not None), dtype=np.int64)
    pieces = np.array([min(MOST_BUCKETS, common[k] // ROWS_IN_BUCKET) for k in hot.tolist()], dtype=np.int64)
    of_null = max(1, min(MOST_BUCKETS, common.get(None, 0) // ROWS_IN_BUCKET))
    cuts = np.array(sorted({*map(int, cuts), *hot.tolist(), *(hot + 1).tolist()}), dtype=np.int64)

    @F.pandas_udf("long")
    def bucket_of(keys: pd.Series, h: pd.Series) -> pd.Series:
        none, known = keys.isna().to_numpy(), keys.fillna(0).to_numpy().astype(np.int64)
        bucket = np.where(none, 0, np.searchsorted(cuts, known, "right") + 1)
        n = np.where(none, of_null, 1)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, known), len(hot) - 1)
            n = np.where(~none & (hot[at] == known), pieces[at], n)
        share = (h.to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)
        return pd.Series(bucket * (1 << 20) + (share.astype(np.int64) * n >> 32))

    rows = docs.withColumn("h", F.xxhash64("text")).withColumn("bucket", bucket_of("key", "h"))
    least = rows.groupBy("bucket").agg(F.min(F.struct("key", "h")).alias("first")).orderBy("bucket").collect()
    seats = [(least[i - 1].bucket, r.bucket, r.first.key, r.first.h) for i, r in enumerate(least)]
    seats = F.broadcast(docs.sparkSession.createDataFrame(seats, "seat long, own long, least long, least_h long"))
    firsts = rows.join(seats, (F.col("bucket") == F.col("own")) & F.col("key").eqNullSafe(F.col("least")) & (F.col("h") == F.col("least_h")))
    firsts = firsts.groupBy("seat", "least", "least_h").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    guests = firsts.select(F.col("seat").alias("bucket"), F.lit(1).alias("guest"), F.col("least").alias("key"), F.col("least_h").alias("h"), "text")
    return rows.select("bucket", F.lit(0).alias("guest"), "key", "h", "text").unionByName(guests)


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its sketch, that of its edited text (see ``edited``), and its likeness to that and to the next document.

    The next document is the one with the next key; after the last comes the first, so a lone document follows itself. Null texts
    count as empty; two empty texts have likeness 1. Rows with one key go by a hash of their text. Null keys go first and stay null. Other columns
    are not read. An empty table gives an empty table.
    """
    rows = with_following(docs, key, text).repartition("bucket").sortWithinPartitions("bucket", "guest", "key", "h", "text")
    return rows.select("guest", "key", "text").mapInArrow(_stream, SCHEMA)
