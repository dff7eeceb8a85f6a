"""Language identification by partial matching: a byte context tree per language, with escape probabilities and frozen counts.

A tree holds, for contexts of 0 to ``ORDER`` bytes, how often each byte followed. A byte seen c times after a context of n bytes and
d different followers has probability c / (n + d) there; another byte escapes with d / (n + d) to the context one byte shorter, and
from the empty context to an even choice among 256 bytes. A text's code length under a language is the sum over its bytes; the
shortest wins. Counts stay as trained, so code lengths are table values. A batch of texts is reduced to its distinct runs of ``ORDER``
+ 1 bytes; each language codes these once, from sorted tables of what it has seen, so memory and time grow with the languages' own
contexts and no table spans contexts and languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgraph.llm.arrays import from_texts, row_chunks
from specgraph.llm.common import fold

ORDER = 3
#: Most training characters of a language: labelled rows beyond them are not read, which bounds the model (a few hundred thousand contexts of a language).
TRAIN_BYTES = 3_000_000
#: Documents held out of training.
FOLDS, HELD_OUT = 5, 0
UNKNOWN = "und"


def folded(text: str | None) -> bytes:
    """Lower-cased bytes, with the line ends that a text begins after."""
    return b"\n" * ORDER + (text or "").lower().encode("utf-8", "replace")


@dataclass
class LanguageModel:
    """Counts of each language: (context code, byte, count) arrays for each context length."""

    languages: list[str]
    counts: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(repr=False)

    @cached_property
    def tables(self) -> list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
        """For each language and context length: runs seen (context and byte) with their bits, and contexts seen with the bits of an escape; both ascending."""
        out = []
        for counts in self.counts:
            own = []
            for ctx, byte, count in counts:
                known, at = np.unique(ctx, return_inverse=True)
                total, kinds = np.bincount(at, weights=count, minlength=len(known)), np.bincount(at, minlength=len(known))
                runs = ctx << 8 | byte
                order = np.argsort(runs)
                bits = np.log2((total[at] + kinds[at]) / count)
                own.append((runs[order], bits[order], known, np.log2((total + kinds) / np.maximum(kinds, 1))))
            out.append(own)
        return out

    def run_bits(self, runs: np.ndarray, language: int) -> np.ndarray:
        """Bits of the last byte of each run of ``ORDER`` + 1 bytes, after the bytes before it."""
        bits, todo = np.zeros(len(runs)), np.arange(len(runs))
        for order in range(ORDER, -1, -1):
            seen, cost, known, escape = self.tables[language][order]
            left = runs[todo] & ((1 << 8 * (order + 1)) - 1)
            at = np.minimum(np.searchsorted(seen, left), max(len(seen) - 1, 0))
            hit = seen[at] == left if len(seen) else np.zeros(len(left), dtype=bool)
            bits[todo[hit]] += cost[at[hit]]
            todo, left = todo[~hit], left[~hit] >> 8
            at = np.minimum(np.searchsorted(known, left), max(len(known) - 1, 0))
            if len(known):
                bits[todo] += np.where(known[at] == left, escape[at], 0.0)
        bits[todo] += 8.0
        return bits

    def code_lengths(self, texts: list[str | None]) -> np.ndarray:
        """Bits of each text under each language."""
        buf, offs = from_texts([folded(t) for t in texts])
        code = np.zeros(len(buf) - ORDER, np.uint32)
        for k in range(ORDER + 1):
            code = code << np.uint32(8) | buf[k : len(buf) - ORDER + k].astype(np.uint32)
        runs, place = np.unique(code, return_inverse=True)
        runs = runs.astype(np.int64)
        out = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(code) + 1)
        for k in range(len(self.languages)):
            np.cumsum(self.run_bits(runs, k)[place], out=total[1:])
            out[:, k] = total[offs[1:] - ORDER] - total[offs[:-1]]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The likeliest language of each text, its share, and the text's bits under it for each byte; ``und``, 0 and 8 for a text without a letter. Ties go to the first name."""
        best, share, rate = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), 8.0)
        lettered = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
        if not self.languages or not lettered:
            return best, share, rate
        bits = self.code_lengths([texts[i] for i in lettered])
        least = bits.argmin(axis=1)
        odds = np.exp2(-np.minimum(bits - bits.min(axis=1, keepdims=True), 1000))
        share[lettered] = 1 / odds.sum(axis=1)
        rate[lettered] = bits.min(axis=1) / [len(folded(texts[i])) - ORDER for i in lettered]
        for i, k in zip(lettered, least.tolist(), strict=True):
            best[i] = self.languages[k]
        return best, share, rate


def count_contexts(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(context code, byte, count) for each context length, over all bytes of all texts."""
    buf, offs = from_texts([folded(t) for t in texts])
    at = np.ones(len(buf), dtype=bool)
    for k in range(ORDER):
        at[offs[:-1] + k] = False
    at = np.flatnonzero(at)
    out, code = [], np.zeros(len(at), np.int64)
    for order in range(ORDER + 1):
        if order:
            code = code | buf[at - order].astype(np.int64) << (8 * (order - 1))
        grams, count = np.unique(code << 8 | buf[at], return_counts=True)
        out.append((grams >> 8, (grams & 255).astype(np.int64), count))
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), dtype=object)
        for lang in sorted(set(langs)):
            texts = [batch.column(0)[int(i)].as_py() for i in np.flatnonzero(langs == lang)]
            for order, (ctx, byte, count) in enumerate(count_contexts(texts)):
                n = len(ctx)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, order, np.int8)), pa.array(ctx), pa.array(byte.astype(np.int16)), pa.array(count)], names=["lang", "ord", "ctx", "byte", "n"])


def train(docs: DataFrame, lang: str = "lang", key: str = "doc_id", text: str = "text", train_bytes: int = TRAIN_BYTES) -> LanguageModel:
    """Context trees of every language in ``lang`` over rows that are not held out.

    A language with more than ``train_bytes`` characters is read as a sample of rows (by a hash of the key) of about that size; of
    what is read, every context is kept. Rows without a language or text are left out.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(fold(F.col("key"), FOLDS), F.lit(1)) != HELD_OUT))
    draw = F.pmod(F.xxhash64(F.lit("train"), "key"), F.lit(1 << 20))
    sizes = {r["lang"]: r["size"] for r in rows.groupBy("lang").agg(F.sum(F.length("text")).alias("size")).collect() if r["size"]}
    if not sizes:
        return LanguageModel([], [])
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1 << 20, int(train_bytes / v * (1 << 20)) + 1))])
    sample = rows.where(draw < share[F.col("lang")]).select("text", "lang")
    grams = sample.mapInArrow(_counted, "lang string, ord byte, ctx long, byte short, n long")
    grams = grams.groupBy("lang", "ord", "ctx", "byte").agg(F.sum("n").alias("n"))
    found = grams.groupBy("lang", "ord", "ctx").agg(F.collect_list(F.struct("byte", "n")).alias("next")).toArrow()
    names = sorted(sizes)
    trees = []
    all_lang, all_ord = found.column("lang").to_numpy(), found.column("ord").to_numpy()
    ctxs = found.column("ctx").to_numpy()
    nexts = found.column("next").combine_chunks()
    lo, hi = nexts.offsets.to_numpy()[:-1], nexts.offsets.to_numpy()[1:]
    byte, n = (nexts.values.field(k).to_numpy() for k in range(2))
    for name in names:
        tree = []
        for order in range(ORDER + 1):
            own = np.flatnonzero((all_lang == name) & (all_ord == order))
            own = own[np.argsort(ctxs[own])]
            lens = hi[own] - lo[own]
            at = np.repeat(lo[own] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
            tree.append((np.repeat(ctxs[own], lens), byte[at].astype(np.int64), n[at]))
        trees.append(tree)
    return LanguageModel(names, trees)


def _predicted(column: pa.Array, model: LanguageModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Predictions for a batch's texts, made for a bounded number of signs at once."""
    sizes = np.append(0, np.cumsum(pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)))
    langs: list[str] = []
    shares, rates = [np.zeros(0)], [np.zeros(0)]
    for lo, hi in row_chunks(sizes, 1 << 20):
        some, share, rate = model.predict(column.slice(lo, hi - lo).to_pylist())
        langs += some
        shares.append(share)
        rates.append(rate)
    return langs, np.concatenate(shares), np.concatenate(rates)


def identify(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, shares, _ = _predicted(batch.column(1), held.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(shares)], names=["key", "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang", most: float = 8.0) -> DataFrame:
    """The rows, with all their columns, whose text the model names a language for and codes in fewer than ``most`` bits a byte.

    At 8 bits no language's tree says more than the plain bytes do. ``lang`` becomes the language named.
    """
    held, place, to = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text), docs.columns.index(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, _, rates = _predicted(batch.column(place), held.value)
            columns = [pa.array(langs, batch.column(k).type) if k == to else batch.column(k) for k in range(batch.num_columns)]
            keep = (np.array(langs, dtype=object) != UNKNOWN) & (rates < most)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def identify_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, by a model trained on the rows that are not held out.

    A null text, or one without a letter, is ``und`` with score 0; so is every text where no row has a language. Null keys count as
    not held out and are kept; repeated rows keep a row each. Other columns are not read.
    """
    found = identify(docs, train(docs))
    held_out = F.coalesce(fold(F.col("key"), FOLDS) == HELD_OUT, F.lit(False))
    return found.select(F.col("key").alias("doc_id"), held_out.alias("held_out"), "lang_pred", "score")
