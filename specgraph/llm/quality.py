"""Quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

Random Fourier features approximate a Gaussian kernel, so the linear fit draws curved borders. Each task sums the normal equations
of its rows; the sums are added up in a second step and solved as one small system. Fitted scores are binned, and pooling adjacent
violators over the bins gives the calibration; a small share of the raw score keeps the order within a calibrated step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgraph.llm.arrays import Words, mix64, row_chunks, text_buffers
from specgraph.llm.common import checkpointed, fold

FEATURES, WIDTH, RIDGE, SEED = 200, 3.0, 1.0, 10
FOLDS, HELD_OUT, THRESHOLD, BINS = 3, 1, 0.5, 2000
STATISTICS = (
    "log_chars", "log_words", "word_length", "long_words", "upper", "digits", "symbols", "exclamations", "bars", "stops", "other_signs", "spaces",
    "lines", "not_ascii", "unique_words", "commonest_word", "repeated_lines", "words_in_line",
)

_KINDS = np.full(256, 12, np.uint8)
for _k, _signs in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*@^~<>{}[]\\_=+`", b"!", b"|", b".,;:?", b" \t\r\x0b\x0c", b"\n", bytes(range(0xC0, 256)), bytes(range(0x80, 0xC0)))):
    _KINDS[list(_signs)] = _k


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; an empty text has zeros."""
    n = len(offs) - 1
    lens = np.diff(offs)
    counts = np.bincount(np.repeat(np.arange(n), lens) * 13 + _KINDS[buf], minlength=n * 13).reshape(n, 13).astype(float)
    lower, upper, digit, symbol, bang, bar, stop, space, line, lead, tail, _, other = counts.T
    chars = np.maximum(counts.sum(axis=1) - tail, 1)
    words = Words(buf, offs)
    rows = words.rows()
    n_words = np.diff(words.bounds)
    safe = np.maximum(n_words, 1)
    with np.errstate(over="ignore"):
        keys, first, again = np.unique(words.hashes ^ mix64(rows.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
    distinct = np.bincount(rows[first], minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, rows[first], again)
    ends = np.unique(np.concatenate([offs[1:], np.flatnonzero(buf == 10) + 1]))
    begins = np.append(0, ends[:-1])[: len(ends)]
    owner = np.searchsorted(offs, begins, "right") - 1
    total = np.zeros(len(words.hashes) + 1, np.uint64)
    a, b = np.searchsorted(words.starts, begins), np.searchsorted(words.starts, ends)
    place = np.arange(len(words.hashes)) - np.repeat(a, b - a)
    with np.errstate(over="ignore"):
        np.cumsum(mix64(words.hashes + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), out=total[1:])
        line_key = mix64(total[b] - total[a]) ^ mix64(owner.astype(np.uint64) + np.uint64(1))
    full = (b > a) & (lens[owner] > 0)
    _, where = np.unique(line_key[full], return_index=True)
    n_lines = np.bincount(owner[full], minlength=n)
    fresh = np.bincount(owner[full][where], minlength=n)
    letters = np.maximum(lower + upper + lead, 1)
    out = np.stack(
        [
            np.log1p(chars * (lens > 0)), np.log1p(n_words), np.bincount(rows, weights=np.minimum(words.lens, 40), minlength=n) / safe,
            np.bincount(rows, weights=words.lens > 14, minlength=n) / safe, upper / letters, digit / chars, symbol / chars, bang / safe, bar / safe, stop / safe,
            other / chars, space / chars, line / safe, lead / chars, distinct / safe, top / safe, (n_lines - fresh) / np.maximum(n_lines, 1), np.log1p(n_words / np.maximum(n_lines, 1)),
        ],
        axis=1,
    )
    return out


def document_statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, x array<double>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            for lo, hi in row_chunks(offs):
                x = statistics(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["key", "x"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, x array<double>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class QualityModel:
    """Standardisation, random frequencies, fitted weights and calibration steps."""

    mean: np.ndarray
    spread: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.hstack([np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.weights, -0.5, 1.5)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        edges, levels = self.steps
        level = levels[np.clip(np.searchsorted(edges, raw, "right") - 1, 0, len(levels) - 1)] if len(levels) else np.clip(raw, 0, 1)
        return 0.98 * level + 0.02 * (raw + 0.5) / 2


def pooled(counts: np.ndarray, positives: np.ndarray) -> np.ndarray:
    """Isotonic means of bins in order (pool adjacent violators); an empty bin takes the level before it."""
    blocks: list[list[float]] = []
    for n, p in zip(counts.tolist(), positives.tolist(), strict=True):
        blocks.append([n, p, 1])
        while len(blocks) > 1 and blocks[-2][1] * max(blocks[-1][0], 1e-12) >= blocks[-1][1] * max(blocks[-2][0], 1e-12) or len(blocks) > 1 and blocks[-1][0] == 0:
            n2, p2, k2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n2, blocks[-1][1] + p2, blocks[-1][2] + k2]
    return np.repeat([p / n if n else 0.0 for n, p, _ in blocks], [int(k) for *_, k in blocks])


def fit(rows: DataFrame, seed: int = SEED) -> QualityModel | None:
    """A model from (key, x, y) rows, y 0 or 1, read three times, so they should be a written table; None if there are none. A quarter of the rows, by a hash of the key, calibrates."""
    dims = range(len(STATISTICS))
    row = rows.agg(F.count("*").alias("n"), *(f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in dims for f in (F.avg, F.stddev_pop))).first()
    if not row["n"]:
        return None
    rng = np.random.default_rng(seed)
    spread = np.array([max(row[f"stddev_pop{i}"], 1e-6) for i in dims])
    model = QualityModel(np.array([row[f"avg{i}"] for i in dims]), spread, rng.normal(size=(len(dims), FEATURES)) / WIDTH, rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), (np.zeros(0), np.zeros(0)))
    side = FEATURES + 1

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((side, side + 1))
        for batch in batches:
            z = model.features(_matrix(batch.column(0)))
            both += z.T @ np.hstack([z, batch.column(1).to_numpy(zero_copy_only=False).reshape(-1, 1)])
        yield pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary())], names=["sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((side, side + 1))
        for batch in batches:
            for one in batch.column(0):
                both += np.frombuffer(one.as_py()).reshape(side, side + 1)
        yield pa.RecordBatch.from_arrays([pa.array([both.tobytes()], pa.binary())], names=["sums"])

    part = F.pmod(F.xxhash64(F.lit("part"), "key"), F.lit(4))
    fitted = rows.where(part != 0).select("x", F.col("y").cast("double").alias("y"))
    sums = fitted.mapInArrow(summed, "sums binary").repartition(8).mapInArrow(added, "sums binary").collect()
    both = sum(np.frombuffer(r["sums"]).reshape(side, side + 1) for r in sums)
    penalty = np.eye(side) * RIDGE
    penalty[-1, -1] = 1e-6
    model.weights = np.linalg.solve(both[:, :side] + penalty, both[:, side])

    def raw_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = np.minimum(((model.raw(_matrix(batch.column(0))) + 0.5) / 2 * BINS).astype(np.int32), BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column(1)], names=["bin", "y"])

    held = rows.where(part == 0).select("x", F.col("y").cast("double").alias("y")).mapInArrow(raw_scores, "bin int, y double")
    found = held.groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("p")).collect()
    counts, positives = np.zeros(BINS), np.zeros(BINS)
    for r in found:
        counts[r["bin"]], positives[r["bin"]] = r["n"], r["p"]
    if counts.sum():
        model.steps = (np.arange(BINS) / BINS * 2 - 0.5, pooled(counts, positives))
    return model


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, by a model of ``labels.quality``.

    Labels of held-out documents are not read. Null texts are empty. Null keys have no label and are kept; repeated rows keep a row
    each; repeated or null labels: each label row counts, nulls do not. With no label at all every score is 0.5. Other columns are
    not read.
    """
    stats = checkpointed(document_statistics(docs))
    given = labels.select(F.col("doc_id").alias("key"), F.col("quality").alias("y")).where(F.col("y").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    model = fit(checkpointed(stats.join(given, "key")))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = held.value.score(_matrix(batch.column(1))) if held.value is not None and len(batch) else np.full(len(batch), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["key", "score"])

    scored = stats.mapInArrow(run, f"key {stats.schema['key'].dataType.simpleString()}, score double")
    held_out = F.coalesce(fold(F.col("key"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select(F.col("key").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
