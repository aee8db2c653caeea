"""Removal of repeated 100-byte strings by a distributed, sparse suffix sort.

Every window of WINDOW bytes has an anchor: the start of its smallest K-byte
string by hash, leftmost among equals.  Equal windows have equal anchors at equal
places, so the suffixes at anchors (about one byte in forty) are enough.

1. Documents fall into blocks by hash.  Each block sends the distinct hashes of
   its anchors to the hash ranges and learns which of them occur elsewhere too.
2. For those, each block sorts the suffixes at its anchors, as far as the
   anchor's windows reach, into one run per hash range, front-coded: a common
   prefix length and the rest.  Suffixes equal within the block go once.
3. Each hash range merges its runs with a loser tree whose games compare known
   common prefix lengths first and bytes only from there on.  Equal suffixes are
   repeats as a whole; the merge's prefix lengths tell which windows of the other
   ones can have an equal at all, and only these are compared, byte context
   included, by 64-bit hashes.  What is not the first of its kind goes back to
   its block as removed intervals.
4. Each block joins the intervals to its documents.

A block writes a row for each hash range that it has something for, at most one
a suffix, so rows and work stay linear in the input when ranges outnumber a
block's suffixes.

Of anchors more frequent than HOT each window is a suffix of its own, dealt by
the window's hash, so a very common string is many small groups.

Defined results: null text counts as empty; order is by doc_id (null last), rows
that repeat a doc_id by their texts' hash block and text, then by start; texts
shorter than the window lose nothing; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.packing import pack, range_width, ranges, unpack

WINDOW, K, HOT = 100, 24, 100_000
BLOCK_BYTES, CHUNK = 4 << 20, 1 << 20
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_PLACE = np.uint64((1 << 24) - 1)


def words(data: bytes) -> np.ndarray:
    """The eight bytes from each position on as one number."""
    n = len(data) - 7
    out = np.empty(n, np.uint64)
    for r in range(min(8, n)):
        out[r::8] = np.frombuffer(data, "<u8", (n - r + 7) // 8, r)
    return out


def _mixed(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    x = (a * _P[k % 3]) ^ (a >> np.uint64(31))
    x = (x + b) * _P[(k + 1) % 3]
    return x ^ (x >> np.uint64(29))


def window_hashes(data: bytes) -> np.ndarray:
    """A hash of the WINDOW bytes from each position on."""
    x = words(data)
    for k, size in enumerate((8, 16, 32)):
        x = _mixed(x[:-size], x[size:], k)
    return _mixed(x[: -(WINDOW - 64)], x[WINDOW - 64 :], 0)


def anchors(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, first window, last window, hash of its K bytes), chunk by chunk of a text."""
    reach = WINDOW - K + 1
    for at in range(0, len(data) - WINDOW + 1, CHUNK):
        part = data[at : at + CHUNK + WINDOW - 1]
        w = words(part)
        h = _mixed(_mixed(w[:-16], w[8:-8], 0), w[16:], 1)
        least, size = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), 1
        while 2 * size <= reach:
            least, size = np.minimum(least[:-size], least[size:]), 2 * size
        if size < reach:
            least = np.minimum(least[: size - reach], least[reach - size :])
        place = (least & _PLACE).astype(np.int64)
        turns = np.flatnonzero(place[1:] != place[:-1]) + 1
        first, last = np.concatenate([[0], turns]), np.concatenate([turns - 1, [len(place) - 1]])
        anchor = place[first]
        # Least hashes crowd at the low end; the ranges they are dealt to need them spread again.
        x = h[anchor] * _P[0]
        yield at + anchor, at + first, at + last, (x ^ (x >> np.uint64(32))) * _P[1]


def _documents(table: pa.Table) -> tuple[pa.Table, list[bytes]]:
    """A block's rows in their fixed order, and their bytes."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    return table, table.column("text").cast(pa.binary()).to_pylist()


def _anchor_hashes(texts: list[bytes]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *(a[3] for t in texts for a in anchors(t))])


def _emit_hashes(parts: int):
    def run(key, table):
        keys, counts = np.unique(_anchor_hashes(_documents(table)[1]), return_counts=True)
        own = ranges(keys, parts)
        return pa.table(
            {
                "part": pa.array([p for p, _, _ in own], pa.int32()),
                "block": pa.array([key[0].as_py()] * len(own), pa.int64()),
                "hashes": pa.array([pack(keys[a:b]) for _, a, b in own], pa.binary()),
                "counts": pa.array([pack(counts[a:b].astype(np.uint32)) for _, a, b in own], pa.binary()),
            }
        )

    return run


def _find_repeats(hot: int):
    """Per hash of each block: 0 single, 1 repeated, 2 hot."""

    def run(key, table):
        own = [unpack(h, np.uint64) for h in table.column("hashes").to_pylist()]
        counts = np.concatenate([unpack(c, np.uint32) for c in table.column("counts").to_pylist()])
        _, at = np.unique(np.concatenate(own), return_inverse=True)
        totals = np.bincount(at, counts)[at]
        flags = ((totals > 1).astype(np.uint8) + (totals > hot)).astype(np.uint8)
        ends = np.cumsum([len(h) for h in own]).tolist()
        return table.select(["part", "block"]).append_column("flags", pa.array([flags[e - len(h) : e].tobytes() for h, e in zip(own, ends)], pa.binary()))

    return run


_RUN = "part int, block long, prefixes binary, lengths binary, rights binary, rests binary, ids binary, rows binary, places binary, local binary"


def _common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of a and b, known to reach ``at``."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    x = int.from_bytes(a[at:n]) ^ int.from_bytes(b[at:n])
    return n - 1 - (x.bit_length() - 1) // 8


def _runs(parts: int):
    """Sorted, front-coded suffix runs of a block, one per hash range."""

    def run(key, docs, flagged):
        block = key[0].as_py()
        table, texts = _documents(docs)
        ids = [(1 << 63) - 1 if i is None else i for i in table.column("doc_id").to_pylist()]
        flags = np.frombuffer(b"".join(flagged.sort_by("part").column("flags").to_pylist()), np.uint8)
        keys = np.unique(_anchor_hashes(texts))
        width = range_width(parts)
        first: dict[tuple[int, bytes, int], tuple[int, int]] = {}
        local: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for row, text in enumerate(texts):
            for anchor, begin, end, h in anchors(text):
                flag = flags[np.searchsorted(keys, h)]
                chosen = np.flatnonzero(flag)
                for p, a, b, x, f in zip(anchor[chosen].tolist(), begin[chosen].tolist(), end[chosen].tolist(), h[chosen].tolist(), flag[chosen].tolist()):
                    if f == 1:
                        windows = ((a, b, x),)
                    else:
                        dealt = window_hashes(text[a : b + WINDOW]).tolist()
                        windows = tuple((s, s, dealt[s - a]) for s in range(a, b + 1))
                    for a, b, x in windows:
                        known = (x // width, text[p : b + WINDOW] + text[a:p], b + WINDOW - p)
                        if known in first:
                            local[known[0]].append((row, a, b + WINDOW))
                        else:
                            first[known] = (row, p)
        by_part: dict[int, list] = defaultdict(list)
        for (part, suffix, right), (row, p) in first.items():
            by_part[part].append((suffix, right, row, p))
        out = []
        for part in sorted(by_part.keys() | local.keys()):
            entries = sorted(by_part[part])
            prefixes, rests, last = [], [], b""
            for suffix, *_ in entries:
                same = _common(last, suffix, 0)
                prefixes.append(same)
                rests.append(suffix[same:])
                last = suffix
            out.append(
                (
                    part,
                    block,
                    np.array(prefixes, np.uint8).tobytes(),
                    np.array([len(e[0]) for e in entries], np.uint8).tobytes(),
                    np.array([e[1] for e in entries], np.uint8).tobytes(),
                    b"".join(rests),
                    pack(np.array([ids[e[2]] for e in entries], np.int64)),
                    pack(np.array([e[2] for e in entries], np.int32)),
                    pack(np.array([e[3] for e in entries], np.int32)),
                    np.array(local[part], np.int32).tobytes(),
                )
            )
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 8]
        return pa.table([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], names=[f.split()[0] for f in _RUN.split(", ")])

    return run


class LoserTree:
    """K-way merge of front-coded runs.

    A player is (common prefix with the last output, run).  In a game the longer
    common prefix wins unread; between equal ones bytes are compared from that
    length on, and the loser keeps its common prefix with the winner.
    """

    def __init__(self, runs: list[tuple[list[int], list[bytes]]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.size = max(1, 1 << (len(runs) - 1).bit_length())
        self.losers: list[tuple[int, int]] = [(0, -1)] * self.size
        self.top = self._build(1) if runs else (0, -1)

    def _player(self, run: int) -> tuple[int, int]:
        return (0, run) if run < len(self.runs) and self.runs[run][1] else (0, -1)

    def _build(self, node: int) -> tuple[int, int]:
        if node >= self.size:
            return self._player(node - self.size)
        winner, loser = self._game(self._build(2 * node), self._build(2 * node + 1))
        self.losers[node] = loser
        return winner

    def _game(self, x: tuple[int, int], y: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        if x[1] < 0 or y[1] < 0:
            return (y, x) if x[1] < 0 else (x, y)
        if x[0] != y[0]:
            return (x, y) if x[0] > y[0] else (y, x)
        a, b = self.runs[x[1]][1][self.at[x[1]]], self.runs[y[1]][1][self.at[y[1]]]
        same = _common(a, b, x[0])
        if a[same:] <= b[same:]:
            return x, (same, y[1])
        return y, (same, x[1])

    def __iter__(self) -> Iterator[tuple[int, int, int]]:
        """(common prefix with the one before, run, index) in order."""
        winner = self.top
        while winner[1] >= 0:
            run = winner[1]
            yield winner[0], run, self.at[run]
            self.at[run] += 1
            prefixes, suffixes = self.runs[run]
            player = (prefixes[self.at[run]], run) if self.at[run] < len(suffixes) else (0, -1)
            node = (run + self.size) >> 1
            while node:
                other = self.losers[node]
                if other[1] >= 0:
                    player, self.losers[node] = self._game(player, other)
                node >>= 1
            winner = player


def _decoded(prefixes: bytes, lengths: bytes, rests: bytes) -> list[bytes]:
    out, last, at = [], b"", 0
    for same, length in zip(prefixes, lengths):
        end = at + length - same
        last = last[:same] + rests[at:end]
        out.append(last)
        at = end
    return out


def _merge(key, table):
    """(block, rows, starts, ends): the removed intervals that one hash range finds, by block."""
    blocks = table.column("block").to_numpy()
    columns = {c: table.column(c).to_pylist() for c in ("prefixes", "lengths", "rights", "rests", "ids", "rows", "places", "local")}
    runs = [(list(p), _decoded(p, n, r)) for p, n, r in zip(columns["prefixes"], columns["lengths"], columns["rests"])]
    removed: dict[int, list[np.ndarray]] = defaultdict(list)
    for block, local in zip(blocks.tolist(), columns["local"]):
        if local:
            removed[block].append(np.frombuffer(local, np.int32).reshape(-1, 3))
    merged = list(LoserTree(runs))
    if merged:
        same, run, index = (np.array(c) for c in zip(*merged))
        sizes = np.cumsum([0, *(len(r[1]) for r in runs)])
        at = sizes[run] + index
        take = lambda name, unpacked: np.concatenate([unpacked(c) for c in columns[name]])[at]
        right = take("rights", lambda c: np.frombuffer(c, np.uint8)).astype(np.int64)
        ids = take("ids", lambda c: unpack(c, np.int64))
        row, place = take("rows", lambda c: unpack(c, np.int32)).astype(np.int64), take("places", lambda c: unpack(c, np.int32)).astype(np.int64)
        suffixes = [runs[r][1][i] for _, r, i in merged]
        length = np.array([len(s) for s in suffixes])
        left, block = length - right, blocks[run]
        rank = np.empty(len(at), np.int64)
        rank[np.lexsort((place, row, block, ids))] = np.arange(len(at))
        # Equal suffixes with equal contexts stand together: all but the first document's are repeats as a whole.
        new = np.ones(len(at), bool)
        new[1:] = (same[1:] < length[1:]) | (length[1:] != length[:-1]) | (right[1:] != right[:-1])
        kind = np.cumsum(new) - 1
        earliest = np.full(kind[-1] + 1, len(at), np.int64)
        np.minimum.at(earliest, kind, rank)
        whole = rank != earliest[kind]
        longest = np.maximum(same, np.append(same[1:], 0))
        # Windows that start less than WINDOW - longest before the anchor meet no equal one.
        count = left - (WINDOW - np.minimum(right, longest)) + 1
        own = np.flatnonzero(~whole & (count > 0))
        own = own[np.argsort(rank[own])]
        found = [(block[whole], row[whole], (place - left)[whole], (place + right)[whole])]
        if len(own):
            hashes, whichs, steps = [], [], []
            for at in range(0, len(own), 2048):  # bounds the hashes held at every byte
                few = own[at : at + 2048]
                context = [suffixes[i][r:] + suffixes[i][:r] for i, r in zip(few.tolist(), right[few].tolist())]
                base = np.cumsum([0, *map(len, context)])[:-1]
                n = count[few]
                which = np.repeat(np.arange(len(few)), n)
                step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                hashes.append(window_hashes(b"".join(context) + bytes(WINDOW))[base[which] + step])
                whichs.append((which + at).astype(np.int32))
                steps.append(step.astype(np.int32))
            which, step = np.concatenate(whichs), np.concatenate(steps)
            _, firsts = np.unique(np.concatenate(hashes), return_index=True)
            del hashes, whichs, steps
            again = np.ones(len(which), bool)
            again[firsts] = False
            d = np.flatnonzero(again)
            if len(d):
                breaks = np.flatnonzero((np.diff(d) != 1) | (np.diff(which[d]) != 0))
                a, b = d[np.concatenate([[0], breaks + 1])], d[np.concatenate([breaks, [len(d) - 1]])]
                r = own[which[a]]
                found.append((block[r], row[r], (place - left)[r] + step[a], (place - left)[r] + step[b] + WINDOW))
        b, r, s, e = (np.concatenate(c) for c in zip(*found))
        order = np.argsort(b, kind="stable")
        cuts = np.flatnonzero(np.diff(b[order])) + 1
        for group in np.split(order, cuts) if len(order) else ():
            removed[int(b[group[0]])].append(np.stack([r[group], s[group], e[group]], 1).astype(np.int32))
    packed = [np.concatenate(x) for x in removed.values()]
    return pa.table({"block": pa.array(list(removed), pa.int64()), "spans": pa.array([pack(np.ascontiguousarray(x.T).reshape(-1)) for x in packed], pa.binary())})


def _apply(key, docs, intervals):
    table, texts = _documents(docs)
    spans = [unpack(s, np.int32).reshape(3, -1) for s in intervals.column("spans").to_pylist()]
    row, start, end = np.concatenate(spans, 1) if spans else np.zeros((3, 0), np.int32)
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    bounds = np.searchsorted(row, np.arange(len(texts) + 1)).tolist()
    removed, runs, digests, kept = [], [], [], []
    for k, text in enumerate(texts):
        merged: list[list[int]] = []
        for s, e in zip(start[bounds[k] : bounds[k + 1]].tolist(), end[bounds[k] : bounds[k + 1]].tolist()):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        at, pieces = 0, []
        for s, e in merged:
            pieces.append(text[at:s])
            at = e
        rest = b"".join([*pieces, text[at:]])
        removed.append(len(text) - len(rest))
        runs.append(len(merged))
        digests.append(hashlib.sha256(rest).hexdigest())
        kept.append(rest)
    return pa.table({"doc_id": table.column("doc_id").cast(pa.int64()), "n_bytes": pa.array(map(len, texts), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(runs, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept": pa.array(kept, pa.binary())})


def _apply_digests(key, docs, intervals):
    return _apply(key, docs, intervals).drop_columns(["kept"])


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, hot: int = HOT, with_bytes: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if with_bytes, kept: the bytes left of each document."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    dealt = own.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    hashes = dealt.groupBy("block").applyInArrow(_emit_hashes(blocks), "part int, block long, hashes binary, counts binary")
    flags = hashes.groupBy("part").applyInArrow(_find_repeats(hot), "part int, block long, flags binary")
    runs = dealt.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(_runs(blocks), _RUN)
    spans = runs.groupBy("part").applyInArrow(_merge, "block long, spans binary")
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return dealt.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_apply if with_bytes else _apply_digests, result + ", kept binary" * with_bytes)
