"""Phrase collocation mining: frequent phrases by Misra-Gries summaries, exact counts, and a score against the best cut.

Phrases are dealt to hash partitions. A task sends each partition what it has counted of it, and the partition merges these into a summary of a
bounded number of counters: equal phrases are added up, and when there are more than the capacity, the count that would leave no more is
taken from all of them. What is taken in all is an upper bound of how much any phrase was undercounted. Capacity exceeds a partition's
mass divided by the threshold, so that bound stays below the threshold and every frequent phrase survives; where a partition turns out to be
heavier than its share, capacity is doubled instead of taking more. Survivors whose count with the bound reaches the threshold are candidates.

Words and pairs of words come first; longer phrases are dealt only where all their pairs are candidates, for a phrase is no more frequent
than its parts. A last reading counts the candidates exactly, partition by partition, and keeps their texts. Between readings candidates are known by a filter of fixed size: it
lets all of them through, and others at a small rate, which the exact counts remove.

A language is any value of ``lang``, and a part of every hash. A phrase is known by 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specgraph.llm.arrays import FOLDED_CODES, Words, mix64, row_chunks, text_buffers
from specgraph.llm.common import checkpointed, lookup

U64 = np.uint64
LEAST, MOST_WORDS, TOP, NO_LANGUAGE = 100, 5, 2000, "und"
#: Counters for each ``LEAST`` of a partition's expected mass, and that mass.
SLACK, PART_MASS = 4, 1 << 22
#: Phrases that a task holds before it counts and sends them, and most that it sends in a row.
FLUSH, ROW = 1 << 22, 1 << 17
#: Candidates that a task counts before it sends them.
KEPT = 1 << 20
#: Filter: bits, turns of a hash that set one each, and bits in one of the pages that it is made of.
FILTER_BITS, TURNS, PAGE_BITS = 26, (1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5), 15
#: Whole numbers of up to 38 digits.
SCORE = "cast(1000 as decimal(38,0)) * a * n div (cast(l as decimal(38,0)) * r)"
#: Parts of a language in the first selection, and most languages that are sent to all machines; more are joined by key.
PARTS, FEW = 64, 10_000
WORD_BYTES = np.ones(256, dtype=bool)
WORD_BYTES[[*b" \t", *b".,;:!?", *range(0x0A, 0x0E)]] = False
CUT = np.zeros(256, np.int64)
CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = 1
_PLACE = mix64(np.arange(1, MOST_WORDS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def with_language(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, salt, text): the language, ``NO_LANGUAGE`` if there is none, and a hash of it."""
    named = F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE))
    return docs.select(named.alias("lang"), F.xxhash64(named).alias("salt"), F.coalesce(F.col(text), F.lit("")).alias("text"))


class Phrases:
    """Words of a chunk of texts, and hashes of all stretches of words that lie in one piece."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, salts: np.ndarray):
        self.words = Words(buf, offs, WORD_BYTES, FOLDED_CODES)
        cuts = np.append(0, np.cumsum(CUT[buf]))
        rows = self.words.rows()
        piece = cuts[self.words.starts] + rows  # grows from piece to piece and from text to text
        self.salts = salts[rows]
        #: Words from each one to its piece's end.
        ends = np.append(np.flatnonzero(piece[1:] != piece[:-1]) + 1, len(piece)) if len(piece) else np.zeros(0, np.int64)
        self.left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(len(piece))

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word) of each phrase of ``n`` words."""
        at = np.flatnonzero(self.left >= n)
        with np.errstate(over="ignore"):
            total = self.salts[at] + U64(n)
            for k in range(n):
                total = total + self.words.hashes[at + k] * _PLACE[k]
        return mix64(total), at

    def text(self, first: int, n: int) -> bytes:
        w = self.words
        return b" ".join(w.buf[w.starts[i] : w.ends[i]].tobytes().lower() for i in range(first, first + n))


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(hashes, return_counts=True)


class Summary:
    """Misra-Gries counters by hash; ``taken`` is the most that any count is too low."""

    def __init__(self, capacity: int, least: int):
        self.capacity, self.least, self.taken = capacity, least, 0
        self.keys, self.counts = np.zeros(0, U64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        both = np.concatenate([self.keys, keys])
        self.keys, place = np.unique(both, return_inverse=True)
        self.counts = np.bincount(place, weights=np.concatenate([self.counts, counts]), minlength=len(self.keys)).astype(np.int64)
        while len(self.keys) > self.capacity:
            take = int(np.partition(self.counts, -self.capacity - 1)[-self.capacity - 1])
            if self.taken + take >= self.least:
                self.capacity *= 2
                continue
            self.taken += take
            kept = self.counts > take
            self.keys, self.counts = self.keys[kept], self.counts[kept] - take

    def frequent(self) -> np.ndarray:
        return self.keys[self.counts + self.taken >= self.least]


def filter_places(hashes: np.ndarray, turn: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((hashes * U64(turn)) >> U64(64 - FILTER_BITS)).astype(np.int64)


def passing(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes the filter lets through."""
    ok = np.ones(len(hashes), dtype=bool)
    for turn in TURNS:
        at = filter_places(hashes, turn)
        ok &= (flags[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return ok


def dealt(docs: DataFrame, lengths: tuple[int, ...], parts: int, pairs: bytes | None = None) -> DataFrame:
    """(part, keys, counts): what each task counted of phrases of so many words; with a filter of pairs, only of those whose pairs it lets through."""
    held = docs.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = None if held.value is None else np.frombuffer(held.value, np.uint8)
        kept, size = [], 0

        def flushed() -> Iterator[pa.RecordBatch]:
            keys, counts = counted(np.concatenate([np.zeros(0, U64), *kept]))
            part = (keys % U64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            keys, counts, part = keys[order], counts[order], part[order]
            edges = np.unique(np.concatenate([np.searchsorted(part, np.arange(parts + 1)), np.arange(0, len(keys), ROW)]))
            for lo, hi in zip(edges, edges[1:], strict=False):
                yield pa.RecordBatch.from_arrays([pa.array([int(part[lo])]), pa.array([keys[lo:hi].tobytes()]), pa.array([counts[lo:hi].astype(np.uint32).tobytes()])], names=["part", "keys", "counts"])

        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            salts = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
            for lo, hi in row_chunks(offs):
                phrases = Phrases(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], salts[lo:hi])
                good = None
                if flags is not None:
                    h, at = phrases.of(2)
                    good = np.zeros(len(phrases.left) + MOST_WORDS, dtype=bool)
                    good[at] = passing(flags, h)
                for n in lengths:
                    h, at = phrases.of(n)
                    if good is not None:
                        ok = np.ones(len(at), dtype=bool)
                        for k in range(n - 1):
                            ok &= good[at + k]
                        h = h[ok]
                    kept.append(h)
                    size += len(h)
                if size > FLUSH:
                    yield from flushed()
                    kept, size = [], 0
        yield from flushed()

    return docs.select("salt", "text").mapInArrow(run, "part long, keys binary, counts binary")


def frequent_hashes(rows: DataFrame, mass: int, parts: int, least: int) -> DataFrame:
    """(hash) of every phrase of ``dealt`` rows that is found ``least`` times or more, and of some that are found less often."""
    capacity = SLACK * (mass // parts // least + 1) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, summary = None, Summary(capacity, least)
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column(0)[i].as_py()
                if part != now:
                    yield pa.RecordBatch.from_arrays([pa.array(summary.frequent().view(np.int64))], names=["hash"])
                    now, summary = part, Summary(capacity, least)
                summary.merge(*(np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in ((1, U64), (2, np.uint32))))
        yield pa.RecordBatch.from_arrays([pa.array(summary.frequent().view(np.int64))], names=["hash"])

    return rows.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "hash long")


def filter_of(hashes: DataFrame) -> bytes:
    """The filter's bits. Pages are made by Spark; their bytes together are fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(U64)
            for turn in TURNS:
                at = np.unique(filter_places(h, turn))
                yield pa.RecordBatch.from_arrays([pa.array((at >> PAGE_BITS).astype(np.int32)), pa.array((at & ((1 << PAGE_BITS) - 1)).astype(np.int32))], names=["page", "bit"])

    table = np.zeros(1 << FILTER_BITS, dtype=bool).reshape(-1, 1 << PAGE_BITS)
    for row in hashes.mapInArrow(run, "page int, bit int").groupBy("page").agg(F.collect_set("bit").alias("bits")).toLocalIterator():
        table[row["page"], row["bits"]] = True
    return np.packbits(table.reshape(-1), bitorder="little").tobytes()


class Tally:
    """Exact counts of phrases by hash, with the number of words and the text of each, found once."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, U64), np.zeros(0, np.int64)
        self.words, self.texts = np.zeros(0, np.uint8), np.zeros(0, object)

    def add(self, keys: np.ndarray, counts: np.ndarray, words: np.ndarray, texts: Callable[[np.ndarray], list[bytes]]) -> None:
        """``keys`` differ from each other; ``texts`` gives those of the keys at some places, and is asked for new ones only."""
        if not len(keys):
            return
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        self.counts[at[known]] += counts[known]
        new = np.flatnonzero(~known)
        if len(new):
            named = np.empty(len(new), object)
            named[:] = texts(new)
            both = np.concatenate([self.keys, keys[new]])
            order = np.argsort(both, kind="stable")
            self.keys, self.counts = both[order], np.concatenate([self.counts, counts[new]])[order]
            self.words, self.texts = np.concatenate([self.words, words[new]])[order], np.concatenate([self.texts, named])[order]


def tallied(docs: DataFrame, candidates: bytes, parts: int) -> DataFrame:
    """(lang, part, keys, counts, words, texts): what each task counted of the candidates, a row for each language and hash partition."""
    held = docs.sparkSession.sparkContext.broadcast(candidates)
    names = ["lang", "part", "keys", "counts", "words", "texts"]

    def rows(found: dict[str, Tally]) -> Iterator[pa.RecordBatch]:
        for lang, t in found.items():
            part = (t.keys % U64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            edges = np.unique(np.append(np.flatnonzero(np.diff(part[order], prepend=-1)), len(order)))
            for lo, hi in zip(edges, edges[1:], strict=False):
                mine = order[lo:hi]
                packed = [t.keys[mine].tobytes(), t.counts[mine].tobytes(), t.words[mine].tobytes(), b"\n".join(t.texts[mine])]  # no word has a line end
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([int(part[mine[0]])]), *(pa.array([x], pa.binary()) for x in packed)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.frombuffer(held.value, np.uint8)
        found: dict[str, Tally] = {}
        for batch in batches:
            buf, offs = text_buffers(batch.column(2))
            salts = batch.column(1).to_numpy(zero_copy_only=False).view(U64)
            langs = dict(zip(salts.tolist(), batch.column(0).to_pylist(), strict=True))
            for lo, hi in row_chunks(offs):
                phrases = Phrases(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], salts[lo:hi])
                for n in range(1, MOST_WORDS + 1):
                    h, at = phrases.of(n)
                    ok = passing(flags, h)
                    h, at = h[ok], at[ok]
                    for salt in np.unique(phrases.salts[at]).tolist():
                        own = phrases.salts[at] == U64(salt)
                        keys, first, times = np.unique(h[own], return_index=True, return_counts=True)
                        starts = at[own][first]
                        found.setdefault(langs[salt], Tally()).add(keys, times, np.full(len(keys), n, np.uint8), lambda new, starts=starts, n=n: [phrases.text(i, n) for i in starts[new].tolist()])
                if sum(len(t.keys) for t in found.values()) > KEPT:
                    yield from rows(found)
                    found = {}
        yield from rows(found)

    return docs.mapInArrow(run, "lang string, part long, keys binary, counts binary, words binary, texts binary")


def exact_counts(docs: DataFrame, candidates: bytes, parts: int, least: int) -> DataFrame:
    """(lang, phrase, n_words, times) of the phrases found ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tally = None, Tally()

        def frequent() -> pa.RecordBatch:
            some = np.flatnonzero(tally.counts >= least)
            texts = pa.array([t.decode() for t in tally.texts[some]], pa.string())
            return pa.RecordBatch.from_arrays([pa.array([now[0] if now else None] * len(some), pa.string()), texts, pa.array(tally.words[some].astype(np.int32)), pa.array(tally.counts[some])], names=["lang", "phrase", "n_words", "times"])

        for batch in batches:
            for i in range(batch.num_rows):
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if key != now:
                    yield frequent()
                    now, tally = key, Tally()
                keys, counts, words = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in ((2, U64), (3, np.int64), (4, np.uint8)))
                texts = np.array(batch.column(5)[i].as_py().split(b"\n"), object)
                tally.add(keys, counts, words, lambda new, texts=texts: list(texts[new]))
        yield frequent()

    rows = tallied(docs, candidates, parts).repartition(parts, "lang", "part").sortWithinPartitions("lang", "part")
    return rows.mapInArrow(run, "lang string, phrase string, n_words int, times long")


def word_totals(docs: DataFrame) -> DataFrame:
    """(lang, n): all word occurrences of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            for lo, hi in row_chunks(offs):
                words = Words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], WORD_BYTES)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(words.bounds))], names=["lang", "n"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n"))


def joined(words: Column) -> Column:
    return F.array_join(words, " ")


def part_phrases(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, times): for each phrase its shorter stretches of two words or more, with the phrase's own count."""
    words = F.split("phrase", " ")
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("n_words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("n_words") - n + 1), lambda i: joined(F.slice(words, i, n)))))
    return phrases.where("n_words > 2").select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "times")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases.

    Null texts are empty; texts without a language are of ``NO_LANGUAGE``. Repeated rows count each. Other columns are not read. Languages
    without a phrase that is found ``least`` times, and an empty table, give no rows. Whole numbers of up to 38 digits keep the score exact.
    """
    docs = with_language(docs, lang, text)
    totals = checkpointed(word_totals(docs))
    mass = int(totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    parts = 2 * mass // PART_MASS + 1
    short = checkpointed(frequent_hashes(dealt(docs, (1, 2), parts), 2 * mass, parts, least))
    longer = frequent_hashes(dealt(docs, tuple(range(3, MOST_WORDS + 1)), parts, filter_of(short)), 2 * mass, parts, least)
    counts = checkpointed(exact_counts(docs, filter_of(short.unionByName(longer)), parts, least))
    phrases = counts.where("n_words > 1")
    longest = part_phrases(phrases).groupBy("lang", "phrase").agg(F.max("times").alias("within"))
    kept = phrases.join(longest, ["lang", "phrase"], "left").where("within is null or within < times")
    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("n_words") - 1), lambda k: F.struct(k.alias("k"), joined(F.slice(words, 1, k)).alias("head"), joined(F.slice(words, k + 1, F.col("n_words") - k)).alias("tail")))
    cut = kept.select("lang", "phrase", F.col("times").alias("a"), F.inline(cuts))
    for side, name in (("head", "l"), ("tail", "r")):
        cut = lookup(checkpointed(cut), counts.select("lang", F.col("phrase").alias(side), F.col("times").alias(name)), "lang", side)
    cut = cut.join(F.broadcast(totals), "lang") if totals.limit(FEW + 1).count() <= FEW else cut.join(totals, "lang")
    scored = cut.withColumn("score", F.expr(SCORE).cast("long"))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("s")).select("lang", "phrase", "s.*")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
