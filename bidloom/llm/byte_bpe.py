"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier 1 is a minimal perfect hash over the vocabulary: one probe tells whether a
whole pre-token is a vocabulary entry.  Tier 2, for the others, merges the
pre-token's bytes, held in a doubly linked list, in the order a heap of
(rank, position) gives, which is the library order: lowest rank first, leftmost
first among equals.

The text is encoded where it lies: one narrow map over the input, no shuffle.
What travels to the executors is the vocabulary alone (fixed size, a few MB).

Defined results: null text counts as empty; an empty text has no tokens; rows
are independent, so repeated rows and ids give repeated rows; an empty table
gives an empty table; only the two named columns are read, so any further
columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pre-tokens whose ids a Python worker remembers before it starts anew.
MEMO_ENTRIES = 400_000
_MIX = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: base64 token and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


@dataclass
class PerfectHash:
    """Minimal perfect hash: as many slots as keys, one displacement per bucket.

    A bucket's displacement d sends its keys to free slots; a bucket of one key
    stores its slot as -slot - 1, so the last free slots need no search.
    """

    displacement: list[int]
    keys: list[bytes]
    values: list[int]

    @staticmethod
    def _slot(h: int, d: int, n: int) -> int:
        x = ((h ^ (d * _MIX)) * 0xBF58476D1CE4E5B9) & _MASK
        return (x ^ (x >> 31)) % n

    @classmethod
    def build(cls, table: dict[bytes, int]) -> PerfectHash:
        n = len(table)
        buckets: list[list[tuple[int, bytes]]] = [[] for _ in range(max(1, n // 3))]
        for key in table:
            h = xxhash.xxh3_64_intdigest(key)
            buckets[h % len(buckets)].append((h, key))
        displacement, slots = [0] * len(buckets), [None] * n
        order = sorted(range(len(buckets)), key=lambda b: -len(buckets[b]))
        free = None
        for b in order:
            bucket = buckets[b]
            if not bucket:
                break
            if len(bucket) == 1:
                if free is None:
                    free = iter([i for i in range(n) if slots[i] is None])
                slot = next(free)
                displacement[b] = -slot - 1
                slots[slot] = bucket[0][1]
                continue
            d = 1
            while True:
                at = {cls._slot(h, d, n) for h, _ in bucket}
                if len(at) == len(bucket) and all(slots[i] is None for i in at):
                    break
                d += 1
            displacement[b] = d
            for h, key in bucket:
                slots[cls._slot(h, d, n)] = key
        return cls(displacement, slots, [table[k] for k in slots])

    def get(self, key: bytes) -> int:
        """The key's value, or -1."""
        if not self.keys:
            return -1
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacement[h % len(self.displacement)]
        slot = -d - 1 if d < 0 else self._slot(h, d, len(self.keys))
        return self.values[slot] if self.keys[slot] == key else -1


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of a pre-token by merging linked bytes in heap order; O(n log n)."""
    n = len(piece)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    end = list(range(1, n + 1))  # each live node covers piece[i:end[i]]
    alive = bytearray(b"\x01" * n)
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop or end[i] != j:
            continue  # one of the two parts has grown or gone since
        alive[j] = 0
        end[i], after[i] = stop, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := get(piece[i : end[after[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[after[i]]))
        if (k := before[i]) >= 0 and (r := get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = after[i]
    return out


class Codec(dict):
    """Pre-token -> its ids as little-endian 32-bit bytes, worked out on first use."""

    def __init__(self, ranks: dict[bytes, int], perfect: PerfectHash, pattern: str):
        super().__init__()
        self.ranks, self.perfect = ranks, perfect
        self.findall = regex.compile(pattern).findall
        size = max(ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def __missing__(self, pretoken: str) -> bytes:
        piece = pretoken.encode()
        whole = self.perfect.get(piece)
        ids = [whole] if whole >= 0 else merge_bytes(piece, self.ranks)
        found = np.array(ids, "<u4").tobytes()
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        self[pretoken] = found
        return found

    def encode(self, text: str) -> bytes:
        return b"".join([self[t] for t in self.findall(text)])

    def decode(self, ids: np.ndarray) -> bytes:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.arange(total) + np.repeat(self.starts[ids] - ends + lengths, lengths)].tobytes()


_CODECS: dict[str, Codec] = {}


def _codec(shared, pattern: str, key: str) -> Codec:
    """The worker's codec of this job; ``key`` is drawn for each job, as workers outlive them."""
    if key not in _CODECS:
        _CODECS.clear()
        ranks, perfect = shared.value
        _CODECS[key] = Codec(ranks, perfect, pattern)
    return _CODECS[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and, if with_ids, token_ids array<int>.

    Each match of ``pattern`` is encoded on its own; no special tokens.
    decoded_sha256 is over the bytes that decoding the ids gives.
    """
    ranks = read_ranks(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast((ranks, PerfectHash.build(ranks)))
    key = uuid.uuid4().hex
    own = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = pa.schema(
        [("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        + ([("token_ids", pa.list_(pa.int32()))] if with_ids else [])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern, key)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # bounds what is held as Python objects
                part = batch.slice(at, 256)
                rows, arrays = [], []
                for text in part.column(1).to_pylist():
                    packed = codec.encode(text)
                    ids = np.frombuffer(packed, "<u4")
                    rows.append((len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
                    if with_ids:
                        arrays.append(ids.astype(np.int32))
                columns = [part.column(0).cast(pa.int64()), *(pa.array([r[k] for r in rows], kind.field(k + 1).type) for k in range(3))]
                if with_ids:
                    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(offsets, np.concatenate(arrays) if arrays else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays(columns, schema=kind)

    out = own.mapInArrow(run, f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", token_ids array<int>" if with_ids else ""))
    return out


def decode_ids(ids: list[int], ranks: dict[bytes, int]) -> bytes:
    """The bytes of some ids, for callers outside a job."""
    tokens = {rank: token for token, rank in ranks.items()}
    return b"".join(tokens[i] for i in ids)
