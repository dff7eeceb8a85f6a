"""Toxicity: a counterfactual-regularised classifier.

A text's features are the hashes of its distinct words and of their beginnings. Logistic weights are fitted on labelled texts with
two penalties: a ridge, and the square of what the score of a labelled sentence changes by when an identity term in it is swapped
for another of its group. Group mentions then weigh alike, and a group that toxic texts mention more often does not raise the score
of neutral mentions.

Only features whose gradient stands out from chance enter the fit, strongest first, until none is left that does, so it is a small
dense Newton solve. Weights are kept by full 64-bit hashes: no two words share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgraph.llm.arrays import Words, from_texts, mix64, row_chunks, text_buffers
from specgraph.llm.common import fold

U64 = np.uint64
FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Most labelled texts of each label that are fitted, drawn by a hash of the key.
SAMPLE = 3000
#: Lengths in bytes of word beginnings. Texts that a feature must occur in; standard deviations its gradient must stand out by.
BEGINNINGS, LEAST, STANDS_OUT = (4, 5, 6), 4, 3.5
RIDGE, SWAP_PENALTY = 0.15, 10.0
#: Identity terms by group. A term is swapped for others of its group.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("female", "male"), ("girls", "boys"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("black", "white", "asian", "latino", "arab"), ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "natives", "foreigners"), ("disabled", "blind", "deaf"), ("old", "young"), ("frauen", "männer"), ("muslime", "christen", "juden"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
Groups = tuple[tuple[str, ...], ...]


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all words and the row of each; a feature stands once for each occurrence."""
    rows = words.rows()
    keys, owner = [words.hashes], [rows]
    for length in BEGINNINGS:
        h, which = words.affix(length)
        keys.append(h)
        owner.append(rows[which])
    return np.concatenate(keys), np.concatenate(owner)


def distinct(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature of a row once, by row."""
    with np.errstate(over="ignore"):
        _, once = np.unique(keys ^ mix64(rows.astype(U64) + U64(1)), return_index=True)
    once = once[np.argsort(rows[once], kind="stable")]
    return keys[once], rows[once]


def term_features(terms: list[str]) -> list[np.ndarray]:
    """The feature hashes of each word alone."""
    words = Words(*from_texts([t.encode() for t in terms]))
    keys, rows = distinct(*features(words))
    return [keys[rows == i] for i in range(len(terms))]


def swaps(sentence_terms: list[list[int]], groups: Groups) -> dict[tuple[int, int], int]:
    """How often each term of the labelled sentences is swapped for each other of its group."""
    place, flat = [], 0
    for group in groups:
        place += [(flat, len(group))] * len(group)
        flat += len(group)
    out: dict[tuple[int, int], int] = {}
    for terms in sentence_terms:
        for t in terms:
            first, size = place[t]
            for other in range(first, first + size):
                if other != t:
                    out[t, other] = out.get((t, other), 0) + 1
    return out


@dataclass
class ToxicityModel:
    keys: np.ndarray  # ascending
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.flags = np.zeros(1 << 18, dtype=bool)
        self.flags[(self.keys >> U64(46)).astype(np.int64)] = True

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        keys, rows = features(Words(buf, offs))
        some = np.flatnonzero(self.flags[(keys >> U64(46)).astype(np.int64)]) if len(self.keys) else np.zeros(0, np.int64)
        at = np.searchsorted(self.keys, keys[some])
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == keys[some] if len(some) else np.zeros(0, dtype=bool)
        keys, rows = distinct(keys[some[hit]], rows[some[hit]])
        z = self.bias + np.bincount(rows, weights=self.weights[np.searchsorted(self.keys, keys)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(keys: np.ndarray, rows: np.ndarray, y: np.ndarray, prior: float, swapped: dict[tuple[int, int], int], terms: list[str], penalty: float = SWAP_PENALTY) -> ToxicityModel:
    """Weights from distinct (feature, row) pairs, labels of the rows, the share of label 1 outside the sample, and swap counts."""
    n = len(y)
    own = term_features(terms)
    names, at = np.unique(keys, return_inverse=True)
    count = np.bincount(at, minlength=len(names))
    forced = np.unique(np.concatenate([own[i] for pair in swapped for i in pair])) if swapped else np.zeros(0, U64)
    usable = (count >= min(LEAST, max(1, n // 20))) & (count < n)
    active = np.flatnonzero(np.isin(names, forced))
    x = np.ones((n, 1))
    theta = np.array([np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))])

    def column(j: int) -> np.ndarray:
        out = np.zeros(n)
        out[rows_of[first[j] : first[j + 1]]] = 1
        return out

    order = np.argsort(at, kind="stable")
    rows_of, first = rows[order], np.append(0, np.cumsum(count))
    while True:
        if len(active) + 1 > x.shape[1]:
            x = np.hstack([x, *(column(j).reshape(-1, 1) for j in active[x.shape[1] - 1 :])])
            theta = np.append(theta, np.zeros(x.shape[1] - len(theta)))
        place = {int(k): i + 1 for i, k in enumerate(names[active])}
        bound = np.eye(x.shape[1]) * RIDGE
        bound[0, 0] = 1e-6
        for (a, b), times in swapped.items():
            d = np.zeros(x.shape[1])
            for keys_of, sign in ((own[a], 1.0), (own[b], -1.0)):
                for k in keys_of.tolist():
                    if k in place:
                        d[place[k]] += sign
            bound += penalty * times * np.outer(d, d)
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
            grad = x.T @ (p - y) + bound @ theta
            hess = (x * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ x + bound
            step = np.linalg.solve(hess, grad)
            theta = theta - step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-3:
                break
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        spread = np.bincount(at, weights=(p * (1 - p))[rows], minlength=len(names)) + 0.5
        pull = np.bincount(at, weights=(y - p)[rows], minlength=len(names)) / np.sqrt(spread)
        pull = np.where(usable, np.abs(pull), 0.0)
        pull[active] = 0.0
        new = np.flatnonzero(pull > STANDS_OUT)
        new = new[np.argsort(-pull[new], kind="stable")][:12]
        if not len(new):
            break
        active = np.append(active, new)
    bias = theta[0] + np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)) - np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    theta = np.append(theta, np.zeros(len(active) + 1 - len(theta)))
    order = np.argsort(names[active])
    return ToxicityModel(names[active][order], theta[1:][order], float(bias))


def train(docs: DataFrame, labels: DataFrame, groups: Groups = IDENTITY, penalty: float = SWAP_PENALTY, sample: int = SAMPLE) -> ToxicityModel:
    """A model from at most ``sample`` labelled texts of each label that are not held out."""
    given = labels.select(F.col("doc_id").alias("key"), F.col("toxic").alias("y")).where(F.col("y").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    sizes = {int(r["y"]): r["n"] for r in given.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return ToxicityModel(np.zeros(0, U64), np.zeros(0), 0.0 if not sizes else (30.0 if 1 in sizes else -30.0))
    terms = [t for g in groups for t in g]
    draw = F.pmod(F.xxhash64(F.lit("toxic"), "key"), F.lit(1 << 30))
    rate = F.when(F.col("y") == 1, F.lit(int(min(1.0, sample / sizes[1]) * (1 << 30)))).otherwise(F.lit(int(min(1.0, sample / sizes[0]) * (1 << 30))))
    chosen = given.where(draw < rate)  # about 2 * sample rows at most, whatever the table holds
    term_words = {int(h): i for i, h in reversed(list(enumerate(Words(*from_texts([t.encode() for t in terms])).hashes)))}
    term_keys = np.array(sorted(term_words), dtype=U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column(0))
            for lo, hi in row_chunks(offs):
                words = Words(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                keys, rows = distinct(*features(words))
                ends = np.searchsorted(rows, np.arange(hi - lo + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys.view(np.int64)))
                found = np.flatnonzero(np.isin(words.hashes, term_keys))
                owner = words.rows()[found] if len(found) else found
                named = [[term_words[int(h)] for h in words.hashes[found[owner == r]]] for r in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), lists, pa.array(named, pa.list_(pa.int32()))], names=["y", "keys", "terms"])

    rows = docs.select(F.col("doc_id").alias("key"), F.col("text")).join(F.broadcast(chosen), "key").select("text", F.col("y").cast("int").alias("y"))
    got = rows.mapInArrow(run, "y int, keys array<long>, terms array<int>").toArrow()
    if not got.num_rows:
        return ToxicityModel(np.zeros(0, U64), np.zeros(0), 0.0)
    lists = got.column("keys").combine_chunks()
    keys, counts = lists.flatten().to_numpy(zero_copy_only=False).view(U64), np.diff(lists.offsets.to_numpy())
    y = got.column("y").to_numpy().astype(float)
    order = np.lexsort((counts, y))  # the same fit whatever order the rows come in
    rank = np.empty(len(y), np.int64)
    rank[order] = np.arange(len(y))
    return fit(keys, rank[np.repeat(np.arange(len(y)), counts)], y[order], sizes[1] / (sizes[0] + sizes[1]), swaps(got.column("terms").to_pylist(), groups), terms, penalty)


def score_documents(docs: DataFrame, labels: DataFrame, groups: Groups = IDENTITY) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``, by a model of ``labels.toxic``.

    Labels of held-out documents are not read. Null texts are empty; an empty text has the score of the bias alone. Null keys have no
    label and are kept; repeated rows keep a row each. With labels of one kind only, scores are near that label; with none, 0.5.
    Other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = text_buffers(batch.column(1))
            for lo, hi in row_chunks(offs):
                scores = held.value.score(buf[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(scores)], names=["key", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, f"key {docs.schema['doc_id'].dataType.simpleString()}, score double")
    held_out = F.coalesce(fold(F.col("key"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select(F.col("key").alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
