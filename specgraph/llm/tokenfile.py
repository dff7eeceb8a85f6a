"""Token-id files: Parquet list columns, one file for each range of document ids, in ascending order.

Ids are dictionary encoded (a vocabulary fits a dictionary page; bit-packed codes follow), the number columns delta encoded
(format version 2). Row groups and pages have set sizes and page indexes, so a reader that wants some documents, or only the
number columns, reads those pages.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specgraph.llm.arrays import row_chunks, text_buffers
from specgraph.llm.common import scratch_path
from specgraph.llm.pieces import IdCache, PieceHashes, byte_level_starts, code_points, row_bounds

#: Writer settings; sizes in bytes. The page row limit keeps pages of short documents small.
LAYOUT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(8 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "5000",
    "parquet.columnindex.truncate.length": "64",
}
SCHEMA = "doc_id long, part int, first long, n_tokens long, ids array<int>"
#: Bytes of text that a worker encodes at once.
CHUNK = 256 << 10


def byte_signs() -> dict[int, str]:
    """The printable sign that the byte-level alphabet has for each byte: itself if it prints in Latin-1, else the next one from U+0100 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_SIGNS = byte_signs()


class ByteLevelEncoder:
    """Ids of a tokenizer of the tokenizers library whose pieces are those of ``byte_level_starts`` and do not depend on each other.

    Texts are split at the tokenizer's added tokens first; then the library's model merges each distinct piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.ids = IdCache(250_000)
        if any(t.lstrip or t.rstrip or t.single_word for t in self.tokenizer.get_added_tokens_decoder().values()):
            raise ValueError("added tokens that take in spaces or match whole words only are not built")

    def added_tokens(self) -> dict[str, int]:
        """Ids of the strings that the tokenizer keeps whole, as it is set now."""
        known = self.tokenizer.get_added_tokens_decoder().items()
        return {t.content: i for i, t in known if t.content and not (t.special and self.tokenizer.encode_special_tokens)}

    def encode(self, texts: list[str], end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, each followed by ``end_id`` unless that is None, and n + 1 offsets."""
        added = self.added_tokens()
        if any(t in text for text in texts for t in added):
            ids, bounds = self.encode_split(texts, added)
        else:
            ids, bounds = self.encode_pieces(texts)
        if end_id is None:
            return ids, bounds
        return np.insert(ids, bounds[1:], np.int32(end_id)), bounds + np.arange(len(bounds))

    def encode_split(self, texts: list[str], added: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of texts that hold added tokens: what lies between them is encoded like texts of its own. The longest of tokens that begin at one place counts."""
        token = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")")
        parts, after, n_parts = [], [], []
        for text in texts:
            found = token.split(text)
            parts += found[::2]
            after += [*(added[t] for t in found[1::2]), -1]
            n_parts.append(len(found) // 2 + 1)
        ids, bounds = self.encode_pieces(parts)
        follows = np.array(after, dtype=np.int32)
        some = follows >= 0
        ids = np.insert(ids, bounds[1:][some], follows[some])
        return ids, (bounds + np.append(0, np.cumsum(some)))[np.append(0, np.cumsum(n_parts))]

    def encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and offsets of texts without added tokens."""
        whole, cps, offs = code_points(texts)
        pieces = PieceHashes(cps, offs, byte_level_starts(cps, offs))

        def make(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            new = [whole[a:b] for a, b in zip(pieces.starts[at].tolist(), pieces.ends[at].tolist(), strict=True)]
            got = [[t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(BYTE_SIGNS))] for p in new]
            return np.array([i for ids in got for i in ids], dtype=np.int32), np.array([len(ids) for ids in got], dtype=np.int64)

        ids, lens = self.ids.encode(pieces.hashes, make)
        return ids, row_bounds(pieces.bounds, lens)


@cache
def encoder(path: str) -> ByteLevelEncoder:
    """One for each worker, with its cache."""
    return ByteLevelEncoder(path)


def list_array(values: np.ndarray, offs: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(values))


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 0, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every text and writes (doc_id, part, first, n_tokens, ids): files are parts in ascending key order, rows in order within.

    ``first`` is the number of the part's ids before the document. A null text is empty and gets the end id alone. Null keys come
    first; rows with one key go by a hash of their text, so that a key with many rows is spread over parts too. Keys must be whole
    numbers. Other columns are not read. The path must not exist.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer_path)
        for batch in batches:
            for lo, hi in row_chunks(text_buffers(batch.column(1))[1], CHUNK):
                ids, bounds = enc.encode([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()], end_id)
                counts = np.diff(bounds)
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)), pa.array(first + bounds[:-1]), pa.array(counts), list_array(ids, bounds)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "first", "n_tokens", "ids"])
                first += int(bounds[-1])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    order = (F.col("key").asc_nulls_first(), F.xxhash64("text").asc())
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    dealt.mapInArrow(run, SCHEMA).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows; filters on doc_id and column choices reach the pages."""
    return spark.read.schema(SCHEMA).parquet(path)


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        raw = memoryview(np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False), dtype="<u4").view(np.uint8))
        offs = (lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()) * 4
        crcs = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip(offs, offs[1:], strict=False)), dtype=np.int64, count=len(lists))
        counts = np.diff(offs) // 4
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(counts), pa.array(crcs)], names=["doc_id", "part", "first", "n_tokens", "ids_crc32"])


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files: start counts the ids of all documents before; the crc is over the ids as little-endian 32-bit numbers."""
    stored = read_tokens(spark, path)
    sizes = stored.groupBy("part").agg(F.sum("n_tokens").alias("size"))  # as many rows as there are files
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    found = stored.select("doc_id", "part", "first", "ids").mapInArrow(_crc, "doc_id long, part int, first long, n_tokens long, ids_crc32 long")
    return found.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def tokenize_to_files(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Writes the token files (to a new path in the shared folder if none is given) and reads the positions back from them."""
    path = path or scratch_path(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer_path)
    return token_positions(docs.sparkSession, path)
