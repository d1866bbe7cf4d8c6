"""Byte-level BPE encoding with content-defined chunk reuse, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.llm.cluster import ready, table

SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Bytes hashed before a cut (one 64-bit number), mean bytes between cuts, bytes of chunks a worker remembers.
WINDOW, MEAN_CHUNK, CACHE_BYTES = 8, 4096, 48 << 20
#: A longer text is hashed in pieces of this size.
PIECE = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)


def cuts(data: np.ndarray, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Offsets where the rolling hash of the last ``WINDOW`` bytes falls below 2^64 / ``mean``.

    A cut depends on those bytes alone, so a passage is cut alike wherever it stands. Only the first
    byte of a code point is cut before.
    """
    found = []
    for at in range(0, len(data) - WINDOW, PIECE):
        piece = data[at:at + PIECE + WINDOW]
        rolling = np.ndarray((len(piece) - WINDOW,), "<u8", piece, strides=(1,)) * _ODD  # a window is one 64-bit number
        here = np.flatnonzero(rolling < np.uint64((1 << 64) // mean)) + WINDOW
        found.append(here[(piece[here] & 0xC0) != 0x80] + at)
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


class ChunkedBPE:
    """Encodes as the vocabulary's own pre-tokeniser and merges do, chunk by chunk.

    Each chunk, and each text without a cut, is encoded once while it is remembered; what was
    used last is remembered longest. Where two chunks meet, the tokens between the
    last safe point of the left one and the first safe point of the right one are encoded again, over
    the join. A safe point is a blank between two printable ASCII characters: the pre-tokeniser
    starts a piece at every such blank, with or without what surrounds it, so the tokens on its other
    side hold. The join is right once the token boundaries on both sides fall on those points; else
    the next safe points are tried, and at last both chunks are encoded as one.
    """

    def __init__(self, ranks_path: str, pattern: str, cache_bytes: int = CACHE_BYTES):
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            self.length[rank] = len(piece)
        self.known: OrderedDict[bytes, np.ndarray] = OrderedDict()
        self.room = self.left = cache_bytes
        self.encoded = self.reused = self.repaired = self.joined = 0  # times
        self.bytes_in = self.bytes_reused = 0

    def plain(self, text: bytes) -> np.ndarray:
        self.encoded += 1
        return np.array(self.core._core_bpe.encode_ordinary(text.decode()), np.uint32)

    def chunk(self, text: bytes) -> np.ndarray:
        self.bytes_in += len(text)
        if (ids := self.known.get(text)) is not None:
            self.known.move_to_end(text)
            self.reused += 1
            self.bytes_reused += len(text)
            return ids
        ids = self.plain(text)
        self.left -= len(text) + ids.nbytes + 200
        self.known[text] = ids
        while self.left < 0:
            old, was = self.known.popitem(last=False)
            self.left += len(old) + was.nbytes + 200
        return ids

    def encode(self, text: bytes) -> np.ndarray:
        """Ids of a text without special tokens."""
        data = np.frombuffer(text, np.uint8)
        at = [0, *cuts(data).tolist(), len(text)]
        if len(at) == 2:
            return self.chunk(text)
        plain = (data > 32) & (data < 127)
        safe = np.flatnonzero((data[1:-1] == 32) & plain[:-2] & plain[2:]) + 1
        parts: list[np.ndarray] = []
        begin, ids = 0, self.chunk(text[: at[1]])  # the run of chunks joined so far whose tokens may still change
        for middle, end in zip(at[1:-1], at[2:], strict=True):
            right = self.chunk(text[middle:end])
            if (fixed := self.joint(text, safe, begin, ids, middle, right, end)) is None:
                self.joined += 1
                ids = self.plain(text[begin:end])
                continue
            done, cut, ids = fixed
            parts.append(done)
            begin = cut
        parts.append(ids)
        return np.concatenate(parts)

    def joint(self, text: bytes, safe: np.ndarray, begin: int, left: np.ndarray, middle: int, right: np.ndarray, end: int) -> tuple[np.ndarray, int, np.ndarray] | None:
        """(tokens that stand, where they end, tokens after that) of the two neighbours; None if no two safe points agree."""
        i, j = int(np.searchsorted(safe, middle)) - 1, int(np.searchsorted(safe, middle + 1))
        lefts, rights = self.length[left].cumsum() + begin, self.length[right].cumsum() + middle
        for widen in range(4):
            a = int(safe[i - widen]) if i >= widen and safe[i - widen] > begin else begin
            if j + widen >= len(safe) or safe[j + widen] >= end:
                return None
            b = int(safe[j + widen])
            k = int(np.searchsorted(lefts, a)) if a > begin else -1
            m = int(np.searchsorted(rights, b))
            if (k < 0 or lefts[k] == a) and rights[m] == b:
                self.repaired += 1
                return np.concatenate([left[: k + 1], self.plain(text[a:b])]), b, right[m + 1:]
        return None

    def encode_whole(self, text: str) -> np.ndarray:
        """Ids of a text in which the special token's string stands for its id."""
        parts = text.split(SPECIAL)
        out: list[np.ndarray] = []
        for k, part in enumerate(parts):
            if k:
                out.append(np.array([SPECIAL_ID], np.uint32))
            if part:
                out.append(self.encode(part.encode()))
        return np.concatenate(out) if out else np.empty(0, np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        edges = [-1, *np.flatnonzero(ids == SPECIAL_ID).tolist(), len(ids)]
        plain = [self.core.decode_bytes(ids[a + 1:b].tolist()) for a, b in zip(edges, edges[1:], strict=False)]
        return SPECIAL.encode().join(plain).decode("utf-8", "replace")


@lru_cache(1)
def worker_bpe(ranks_path: str, pattern: str) -> ChunkedBPE:
    """One for each Python worker, so that its chunks are shared by all documents of all its tasks."""
    return ChunkedBPE(ranks_path, pattern)


def vocabulary() -> tuple[str, str]:
    """Path of the vocabulary of byte_bpe_50k.json as ranks, and its pre-tokeniser's pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encode_documents(docs: DataFrame, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",), ranks_path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """The columns of ``carry``, n_tokens, ids_sha256 and decoded_sha256 for every row, and the ids themselves if asked for.

    A null or empty text has no tokens and decodes to the empty text. Repeated rows give equal rows, an
    empty table none; other columns are ignored. ``ranks_path`` must exist on every executor.
    """
    ready(docs.sparkSession)
    if ranks_path is None or pattern is None:
        own = vocabulary()
        ranks_path, pattern = ranks_path or own[0], pattern or own[1]
    docs = docs.select(*(F.col(f"`{c}`") for c in carry), F.col(f"`{text}`").cast("string").alias("_text"))
    new = {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.list_(pa.int32())} if with_ids else {})

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for x in part.column(len(carry)):
                    ids = bpe.encode_whole(x.as_py() or "")
                    said = hashlib.sha256(bpe.decode(ids).encode()).hexdigest()
                    rows.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), said, *([ids.astype(np.int32)] if with_ids else [])))
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(new.values())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carry)], *columns], names=[*carry, *new])

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.mapInArrow(coded, f"{schema}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def decode_ids(encoded: DataFrame, *, ids: str = "ids", carry: tuple[str, ...] = ("doc_id",), ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """The columns of ``carry`` and the decoded ``text``; null ids give a null text."""
    ready(encoded.sparkSession)
    if ranks_path is None or pattern is None:
        own = vocabulary()
        ranks_path, pattern = ranks_path or own[0], pattern or own[1]
    encoded = encoded.select(*(F.col(f"`{c}`") for c in carry), F.col(f"`{ids}`").alias("_ids"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(ranks_path, pattern)
        for batch in batches:
            said = [bpe.decode(np.array(x.as_py(), np.int64)) if x.is_valid else None for x in batch.column(len(carry))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(said, pa.string())], names=[*carry, "text"])

    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in carry)
    return encoded.mapInArrow(decoded, f"{schema}, text string")


def op5_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)
