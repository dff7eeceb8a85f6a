"""SentencePiece merge encoding with seeded dropout, and its inverse.

A chunk is a run of spaces with the signs after it; merges never leave a chunk. The agenda of a chunk takes, again and again, the
candidate of best score (leftmost among equals) and merges its two symbols. A candidate is skipped if the hash of (seed, document,
place of the chunk in the text, place in the chunk, merged piece) falls below the dropout rate, so a seed fixes a document's
segmentation, and every occurrence of a word is drawn anew. Rate 0 gives the library's own segmentation. Signs outside the vocabulary
become byte pieces. A literal U+2581, which the library reads as a space, becomes byte pieces as well, so that decoding gives every
text back.

Chunks are handled as arrays: all chunks of like length take an agenda step at once. Nothing is kept from chunk to chunk.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specgraph.llm.arrays import IdTable, from_texts, mix64, row_chunks, text_buffers
from specgraph.llm.pieces import Pieces, code_points, row_bounds
from specgraph.llm.tokenfile import list_array

U64 = np.uint64
MARK = "▁"
DROPOUT, SEED = 0.1, 20
_NONE = np.int32(1 << 30)
_LONG = 32


class MergeModel:
    """Vocabulary of a SentencePiece merge model as arrays: symbol of each sign, candidates of symbol pairs, bytes of each piece."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        byte = np.array([sp.is_byte(i) for i in range(n)])
        plain = np.array([not (byte[i] or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in range(n)])
        if byte.sum() != 256:
            raise ValueError("the model has no byte pieces")
        ids = {names[i]: i for i in range(n) if plain[i]}
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.byte_ids = np.flatnonzero(byte)
        self.symbol = np.full(0x110000, -1, np.int32)
        pairs: dict[int, int] = {}
        for name, i in ids.items():
            if len(name) == 1:
                self.symbol[ord(name)] = i
            for cut in range(1, len(name)):
                a, b = ids.get(name[:cut]), ids.get(name[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.symbol[32], self.symbol[ord(MARK)] = ids[MARK], -1
        self.pairs, self.table = pairs, IdTable(18)
        self.table.put(np.array(list(pairs), dtype=U64), np.array(list(pairs.values()), dtype=np.int32))
        texts = [names[i].replace(MARK, " ").encode() for i in range(n)]
        for value, i in enumerate(self.byte_ids.tolist()):
            texts[i] = bytes([value])
        self.bytes, self.offs = from_texts(texts)

    # --- one agenda step for many chunks -------------------------------------------------------------------------------------

    def _candidates(self, left: np.ndarray, right: np.ndarray, place: np.ndarray, key: np.ndarray, rate: float) -> np.ndarray:
        """The merged piece of each pair of symbols, or -1 if there is none or it is skipped."""
        ok = np.flatnonzero((left >= 0) & (right >= 0))
        out = np.full(left.shape, -1, np.int32)
        got = self.table.get(left[ok].astype(U64) << U64(32) | right[ok].astype(U64))
        if rate > 0:
            got[skipped(key[ok], place[ok], got, rate)] = -1
        out[ok] = got
        return out

    def _merge_many(self, sym: np.ndarray, key: np.ndarray, rate: float) -> np.ndarray:
        """Symbols of each chunk (rows; padded with -2) after its agenda is empty."""
        n, width = sym.shape
        out = np.full((n, width), -2, np.int32)
        rows, place = np.arange(n), np.broadcast_to(np.arange(width), (n, width)).copy()
        pair = self._candidates(sym[:, :-1].ravel(), sym[:, 1:].ravel(), place[:, :-1].ravel(), np.repeat(key, width - 1), rate).reshape(n, width - 1)
        while True:
            order = np.where(pair >= 0, self.rank[pair], _NONE)
            best = order.argmin(axis=1) if order.shape[1] else np.zeros(len(rows), np.int64)
            live = order[np.arange(len(rows)), best] < _NONE if order.shape[1] else np.zeros(len(rows), dtype=bool)
            done = ~live
            out[rows[done], : sym.shape[1]] = sym[done]
            if not live.any():
                return out
            rows, key, best, sym, place, pair = rows[live], key[live], best[live], sym[live], place[live], pair[live]
            every = np.arange(len(rows))
            merged = pair[every, best]
            cols = np.arange(sym.shape[1] - 1)
            take = cols + (cols > best[:, None])
            sym, place = np.take_along_axis(sym, take, 1), np.take_along_axis(place, take, 1)
            sym[every, best] = merged
            cols = np.arange(sym.shape[1] - 1)
            pair = np.take_along_axis(pair, cols + (cols >= best[:, None]), 1)
            for at, ok in ((best - 1, best > 0), (best, best < sym.shape[1] - 1)):
                r, c = every[ok], at[ok]
                pair[r, c] = self._candidates(sym[r, c], sym[r, c + 1], place[r, c], key[r], rate)

    def _merge_long(self, sym: np.ndarray, key: U64, rate: float) -> np.ndarray:
        """The same for one long chunk, with a heap."""
        n = len(sym)
        sym, after, before = sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(at: np.ndarray) -> None:
            at = at[[0 <= i and after[i] < n for i in at.tolist()]] if len(at) else at
            if not len(at):
                return
            left, right = np.array([sym[i] for i in at.tolist()]), np.array([sym[after[i]] for i in at.tolist()])
            for i, m, a, b in zip(at.tolist(), self._candidates(left, right, at, np.full(len(at), key), rate).tolist(), left.tolist(), right.tolist(), strict=True):
                if m >= 0:
                    heapq.heappush(heap, (int(self.rank[m]), i, m, a, b))

        offer(np.arange(n))
        gone = [False] * n
        while heap:
            _, i, m, a, b = heapq.heappop(heap)
            j = after[i] if i < n else n
            if gone[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], gone[j], after[i] = m, True, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(np.array([x for x in (before[i], i) if x >= 0]))
        return np.array([s for s, g in zip(sym, gone, strict=True) if not g], dtype=np.int32)

    def _expand(self, sym: np.ndarray, places: np.ndarray, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replaces symbols -1 by the byte pieces of their sign: ids, and how many each symbol gives."""
        lens = np.ones(len(sym), np.int64)
        out = np.flatnonzero(sym < 0)
        if not len(out):
            return sym, lens
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in cps[places[out]].tolist()]
        lens[out] = [len(x) for x in raw]
        ids = np.repeat(sym, lens)
        ids[ids < 0] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, lens

    def encode(self, texts: list[str], documents: np.ndarray, rate: float = DROPOUT, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end and n + 1 offsets; ``documents`` has a number for each text that its draws depend on. An empty text has no ids."""
        _, cps, offs = code_points([" " + t if t else "" for t in texts])
        if not len(cps):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        space, alone = cps == 32, (cps >= 9) & (cps <= 13)
        start = np.zeros(len(cps) + 1, dtype=bool)
        start[offs] = True
        start = start[:-1]
        start[1:] |= space[1:] & ~space[:-1] | alone[1:] | alone[:-1]
        chunks = Pieces(offs, np.flatnonzero(start))
        counts = np.diff(chunks.bounds)
        number = np.arange(len(chunks.starts)) - np.repeat(chunks.bounds[:-1], counts)
        with np.errstate(over="ignore"):
            document = mix64(documents.astype(np.int64).view(U64) + U64(seed) * U64(0xD1342543DE82EF95) + U64(1))
            keys = mix64(np.repeat(document, counts) + number.astype(U64) * U64(0x632BE59BD9B4E019))

        first, size = chunks.starts, chunks.ends - chunks.starts
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # chunk, symbol, the place of its first sign
        lo = 0
        for hi in (2, 4, 6, 8, 10, 12, 16, 24, _LONG):
            own = np.flatnonzero((size > lo) & (size <= hi))
            lo = hi
            for k in range(0, len(own), 1 << 14):
                some = own[k : k + (1 << 14)]
                cols = np.arange(hi)
                inside = cols < size[some][:, None]
                where = first[some][:, None] + np.minimum(cols, size[some][:, None] - 1)
                sym = np.where(inside, self.symbol[cps[where]], np.int32(-2))
                merged = self._merge_many(sym, keys[some], rate)
                row, col = np.nonzero(merged > -2)
                parts.append((some[row], merged[row, col], first[some[row]] + col))
        for i in np.flatnonzero(size > _LONG).tolist():
            merged = self._merge_long(self.symbol[cps[first[i] : first[i] + size[i]]], keys[i], rate)
            parts.append((np.full(len(merged), i), merged, first[i] + np.arange(len(merged))))
        owner, sym, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(owner, kind="stable")
        owner, sym, place = owner[order], sym[order], place[order]
        # a sign outside the vocabulary is a symbol of its own: its place follows from the lengths of the symbols before it
        width = np.where(sym >= 0, self.signs()[np.maximum(sym, 0)], 1)
        begin = np.cumsum(width) - width
        head = np.searchsorted(owner, owner)
        ids, lens = self._expand(sym, first[owner] + begin - begin[head], cps)
        return ids, row_bounds(chunks.bounds, np.bincount(owner, weights=lens, minlength=len(size)).astype(np.int64))

    @cache
    def signs(self) -> np.ndarray:
        """Number of signs of each piece."""
        lead = np.append(0, np.cumsum((self.bytes & 0xC0) != 0x80))
        return (lead[self.offs[1:]] - lead[self.offs[:-1]]).astype(np.int64)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts on end and n + 1 offsets: the pieces' bytes without the space put before each text."""
        first, lens = self.offs[ids], self.offs[ids + 1] - self.offs[ids]
        end = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(lens, out=end[1:])
        raw = self.bytes[np.arange(int(end[-1])) + np.repeat(first - end[:-1], lens)]
        offs = end[bounds]
        heads = offs[:-1][np.diff(offs) > 0]
        keep = np.ones(len(raw), dtype=bool)
        keep[heads] = False
        return raw[keep], offs - np.append(0, np.cumsum(np.diff(offs) > 0))


def skipped(key: np.ndarray, place: np.ndarray, piece: np.ndarray, rate: float) -> np.ndarray:
    """Whether a candidate is skipped: its draw, by the chunk's key, its place in the chunk and the merged piece, is below the rate."""
    with np.errstate(over="ignore"):
        drawn = mix64(key ^ (place.astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15) + piece.astype(np.int64).view(U64) * U64(0xC2B2AE3D27D4EB4F)))
    return (drawn >> U64(11)).astype(np.float64) * 2.0**-53 < rate


@cache
def model(path: str) -> MergeModel:
    """One for each worker."""
    return MergeModel(path)


def encode_documents(docs: DataFrame, model_path: str, rate: float = DROPOUT, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, n_pieces, ids, lossless) of every row; lossless says that decoding the ids gave the text back.

    Draws depend on the seed, a hash of the row's key and the place in the text, so rows that repeat both key and text are segmented
    alike. A null or empty text has no ids. Repeated rows and null keys are kept. Other columns are not read. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = model(model_path)
        for batch in batches:
            _, offs = text_buffers(batch.column(1))
            document = batch.column(2).to_numpy(zero_copy_only=False)
            for lo, hi in row_chunks(offs, 512 << 10):
                texts = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                ids, bounds = merges.encode(texts, document[lo:hi], rate, seed)
                raw, ends = merges.decode(ids, bounds)
                want, own = from_texts([t.encode() for t in texts])
                same = np.array_equal(raw, want) and np.array_equal(ends, own)
                whole = np.full(hi - lo, True) if same else np.array([raw[a:b].tobytes() == t.encode() for a, b, t in zip(ends, ends[1:], texts, strict=False)])
                columns = [batch.column(0).slice(lo, hi - lo), pa.array([len(t) for t in texts], pa.int64()), pa.array(np.diff(bounds)), list_array(ids, bounds), pa.array(whole)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "n_chars", "n_pieces", "ids", "lossless"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key), F.col(text), F.xxhash64(F.col(key)).alias("document"))
    return rows.mapInArrow(run, f"key {kind}, n_chars long, n_pieces long, ids array<int>, lossless boolean").withColumnRenamed("key", key)


def decode_documents(encoded: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) from ids; null or no ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = model(model_path)
        for batch in batches:
            lists = batch.column(1)
            counts = np.array([len(x) if x.is_valid else 0 for x in lists], dtype=np.int64)
            raw, offs = merges.decode(lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(counts)))
            texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offs, offs[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(key), F.col(ids)).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
