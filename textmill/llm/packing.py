"""Cost-balanced packing of documents into training sequences.

Each task tokenises its rows and packs them window by window (WINDOW tokens, plus the document that crosses it), so
nothing is shuffled, memory is bounded by the window and the longest document, and no key can be hot. In a window:

- a document is cut into full sequences and a rest; the rests are placed in descending order;
- a piece costs LINEAR * n + QUADRATIC * n * n (attention stays inside a piece), a sequence the sum of its pieces;
- each rest goes to the sequence of least cost that has room for it; where none has, it is cut to fill the one with
  the most room, and its remainder is placed in turn;
- sequences hold as many tokens as the window has: the last, partial one is split into powers of two, which need no
  padding. So sequences are padded nowhere, and a window has ten short ones at most.

Defined cases: null or empty text: the end token alone; null doc_id: a document like others; repeated rows: packed as
often as they are given; an empty table: an empty result; further columns are ignored. Texts are tokenised whole.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_memory, worker_cache

CAPACITY, END_ID, WINDOW = 2048, 1, 1 << 20
#: Cost of a token, and of a token pair in attention, in units of the former.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048

#: Longer runs without white space go to the vocabulary's own library, whose merges take n log n steps on a run.
LONG_RUN = 4096


class Encoder:
    """Ids of the byte-level BPE in bpe_path, as its own library gives them without added special tokens. The ranks in
    ranks_path are the same vocabulary for a library that is five times as fast; both give the same ids."""

    def __init__(self, bpe_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._slow = Tokenizer.from_file(bpe_path)
        self._special = [t.content for t in self._slow.get_added_tokens_decoder().values()]
        self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def _is_odd(self, text: str) -> bool:
        """A special token, a long run of anything but white space, or more white space than one character a word."""
        sizes = list(map(len, text.split()))
        return max(sizes, default=0) >= LONG_RUN or len(text) - sum(sizes) - len(sizes) >= LONG_RUN or any(s in text for s in self._special)

    def __call__(self, text: str) -> np.ndarray:
        if self._is_odd(text):
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self._fast.encode_ordinary(text), np.uint32)


def public_encoder_paths() -> tuple[str, str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def piece_cost(n: int) -> float:
    return LINEAR * n + QUADRATIC * n * n


def pack_window(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents with these numbers of tokens."""
    pieces, sequence, rests = [], 0, []
    for d, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            pieces.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rests.append((n % capacity, d, full * capacity))
    total = sum(r[0] for r in rests)
    room = [capacity] * (total // capacity)
    bit = 1
    while bit < capacity:  # the last sequence: powers of two
        if total % capacity & bit:
            room.append(bit)
        bit <<= 1
    size = np.array(room, np.int64)
    room, cost = size.copy(), np.zeros(len(size))
    rests.sort(key=lambda r: (-r[0], r[1]))
    for n, d, start in rests:
        while n:
            fits = np.flatnonzero(room >= n)
            if len(fits):
                k, take = int(fits[np.argmin(cost[fits])]), n
            else:
                k = int(np.argmax(room))
                take = int(room[k])
            pieces.append((d, start, take, sequence + k, int(size[k] - room[k])))
            room[k] -= take
            cost[k] += piece_cost(take)
            start, n = start + take, n - take
    return pieces


_OUT = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


def pack(docs: DataFrame, paths: tuple[str, str, str], capacity: int = CAPACITY, window: int = WINDOW, with_ids: bool = True) -> DataFrame:
    """docs: doc_id, text. One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit; unless
    with_ids is false), ids_crc32, doc_tokens, sequence_id, offset. Sequence ids hold the task's partition number in
    their upper bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        encode = cache.get(("encoder", paths))
        if encode is None:
            release_memory()  # of stages before
            encode = cache[("encoder", paths)] = Encoder(*paths)
        first = TaskContext.get().partitionId() << 33
        ids, docs_, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal first, held
            pieces = pack_window([len(x) for x in ids], capacity)
            rows = []
            for d, start, n, seq, at in pieces:
                raw = ids[d][start : start + n].astype("<u4").tobytes()
                rows.append((docs_[d], start, n, raw if with_ids else None, zlib.crc32(raw), len(ids[d]), first + seq, at))
            first += 1 + max((p[3] for p in pieces), default=-1)
            ids.clear()
            docs_.clear()
            held = 0
            for at in range(0, len(rows), 4096):
                cols = list(zip(*rows[at : at + 4096], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)

        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                x = np.append(encode(text.as_py() or ""), np.uint32(END_ID))
                ids.append(x)
                docs_.append(doc_id)
                held += len(x)
                if held >= window:
                    yield from flush()
        if ids:
            yield from flush()

    schema = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)
    return out if with_ids else out.drop("ids")
