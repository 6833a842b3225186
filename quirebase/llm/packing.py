"""Packing (concatenate and cut): documents become one token stream, cut into fixed windows.

Pass one tokenizes each input partition once, in its own order, and writes (partition, running offset, ids);
pass two adds the prefix sum of the partitions' totals, which gives every document its global offset, and cuts
at multiples of the window. No row is shuffled in either pass; the driver sees one number per partition.

Defined cases: a null or empty text is its end id alone; a null doc_id stays null; repeated rows are documents of
their own; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, written

#: A space with white space on both sides (or the text's end after it): there splitting at spaces would change tokens.
_RUN = re.compile(r"\s (?:\s|\Z)")
#: Words a worker remembers with their ids; the memory is emptied when full.
MEMORY = 400_000


class Tokens(dict):
    """Ids (unsigned, little-endian) of a text under a byte-level BPE file of the tokenizers library.

    Byte-level BPE never merges across the file's pre-tokens, and in a text without runs of white space these never
    reach over a single space. So ids are looked up word by word (this dict: word -> ids of space + word).
    Texts with such runs, or with a special token's string, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"] for t in model["added_tokens"]]
        self.slow = Tokenizer.from_file(path)
        vocab = model["model"]["vocab"]
        self.kind = "<u2" if max(vocab.values(), default=0) < 2**16 else "<u4"
        self.word = self._fast(vocab, model) or self._slow

    def _slow(self, text: str) -> list[int]:
        return self.slow.encode(text, add_special_tokens=False).ids

    def _fast(self, vocab: dict, model: dict):
        """The same merges run by tiktoken, if the file is of the kind that it can run: merges in the order of ids."""
        merges = [m if isinstance(m, str) else " ".join(m) for m in model["model"]["merges"]]
        ids = [vocab[m.replace(" ", "")] for m in merges]
        pre = model.get("pre_tokenizer") or {}
        if model["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or model.get("normalizer") or ids != sorted(ids):
            return None
        import public_tokenizers
        import tiktoken

        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(seen)]
        byte = {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMORY:
            self.clear()
        out = self[word] = self._bytes(self.word(" " + word))
        return out

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._bytes(self._slow(text))
        if _RUN.search(text):
            return self._bytes(self.word(text))
        first, *words = text.split(" ")
        return self._bytes(self.word(first)) + b"".join([self[w] for w in words])


_LOADED: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    if path not in _LOADED:
        _LOADED[path] = Tokens(path)
    return _LOADED[path]


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Rows (doc_id, part, at, n, ids): ids with the end id, at = ids before them in their partition `part`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = tokens(path), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.kind).tobytes()
        width = len(end)
        for batch in batches:
            out = [enc.ids(t or "") + end for t in batch.column(1).to_pylist()]
            n = np.array([len(x) // width for x in out], np.int64)
            ats = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.record_batch([batch.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(ats), pa.array(n), pa.array(out, pa.binary())], ["doc_id", "part", "at", "n", "ids"])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, part int, at long, n long, ids binary")


def packed(docs: DataFrame, path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset): sequence_id's window of the stream at offset.

    Pieces with start > 0 or start + length < doc_tokens are the boundary records of cut documents.
    """
    table = written(tokenized(docs, path, end_id), "tokens")
    totals = dict(table.groupBy("part").agg(F.max(F.col("at") + F.col("n"))).collect())
    parts = sorted(totals)
    base = dict(zip(parts, accumulate([0, *(totals[p] for p in parts)]), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, part, at, n, ids = (batch.column(i) for i in range(5))
            n = n.to_numpy()
            begin = at.to_numpy() + np.array([base[p] for p in part.to_pylist()], np.int64)
            count = (begin + n - 1) // window - begin // window + 1
            row = np.repeat(np.arange(len(n)), count)
            k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            seq = begin[row] // window + k
            lo = np.maximum(seq * window, begin[row])
            hi = np.minimum((seq + 1) * window, (begin + n)[row])
            views = [memoryview(x) for x in ids.to_pylist()]
            width = [len(v) // m for v, m in zip(views, n.tolist(), strict=True)]
            start = lo - begin[row]
            cut = [bytes(views[r][s * width[r] : (s + m) * width[r]]) for r, s, m in zip(row.tolist(), start.tolist(), (hi - lo).tolist(), strict=True)]
            yield pa.record_batch(
                [doc.take(pa.array(row)), pa.array(start), pa.array(hi - lo), pa.array(cut, pa.binary()), pa.array(n[row]), pa.array(seq), pa.array(lo - seq * window)],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
            )

    return table.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def id_crc(pieces: DataFrame) -> DataFrame:
    """The digest columns of the contract: ids_crc32 over little-endian unsigned 32-bit ids, in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, n = batch.column(3).to_pylist(), batch.column(2).to_pylist()
            crc = [zlib.crc32(np.frombuffer(x, f"<u{len(x) // m}").astype("<u4").tobytes()) for x, m in zip(ids, n, strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(crc, pa.int64()), *(batch.column(i) for i in range(4, 7))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return pieces.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
