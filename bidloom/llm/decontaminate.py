"""Benchmark decontamination by template canonicalisation.

Words become a template: numbers, names (capitalised within a sentence) and
units (after a number) turn into typed placeholders, everything else lower case.
Windows of WINDOW template words are hashed and joined between documents and
benchmark items; items shorter than the window are matched as a whole.  A bit
table of fixed size with the benchmark's hashes travels to the documents first,
so only windows the benchmark very likely holds are shuffled; it never changes
a result, however large the benchmark is.

Joined windows on one diagonal (same shift between document and item) are one
alignment.  Its placeholders must map one to one from the item's values to the
document's: each value's mapping is the one most of its slots have (of equals
the smaller value), and a window with a slot that departs from it does not count
unless it repeats the item's words to the letter.  So a re-parameterised question
is caught, one changed number does not hide a copy, and a text that merely
shares the template is left alone.

A document is contaminated by an item when the windows that count cover at least
MIN_COVER of the item's words.

Defined results: null texts count as empty and match nothing, as do items
without words; every input row is a document (an item) of its own, also rows
that repeat an id or have none; an empty table on either side gives no rows;
other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.shared import cut, keyed

WINDOW, MIN_COVER = 8, 0.5
#: Bits of the table of the benchmark's hashes; each hash sets two.
BITS = 1 << 24
MEMO_WORDS = 400_000
NUMBER, NAME, UNIT = "<num>", "<name>", "<unit>"
#: Units and number words, lower case.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg lb lbs oz t ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents pound pounds percent kmh mph w kw v a hz kb mb gb tb degrees celsius fahrenheit meter meters metre metres kilometer kilometers mile miles liter liters litre litres gram grams kilogram kilograms inch inches foot feet".split())
NUMBERS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?:;\n%$€£]")
_ENDS = frozenset(".!?:;\n")
_SIGNS = frozenset("%$€£")
_PRIME = 0x9E3779B97F4A7C15


def template(text: str) -> tuple[list[str], list[str]]:
    """Template words and the words they stand for.

    A sign is a unit next to a number and else no word at all.
    """
    slots, values = [], []
    start, found = True, [(w, w in _ENDS) for w in _TOKEN.findall(text)]
    words = [w for w, end in found if not end]
    k, before = 0, ""
    for word, end in found:
        if end:
            start = True
            continue
        k += 1
        lower = word.lower()
        counted = before[:1].isdigit() or before.lower() in NUMBERS
        if word[0].isdigit() or lower in NUMBERS:
            slot = NUMBER
        elif word in _SIGNS:
            following = words[k] if k < len(words) else ""
            slot = UNIT if counted or following[:1].isdigit() or following.lower() in NUMBERS else ""
        elif lower in UNITS:
            slot = UNIT if counted else lower
        elif not start and word[0].isupper() and not (len(word) > 1 and word.isupper()):
            slot = NAME
        else:
            slot = lower
        if slot:
            slots.append(slot)
            values.append(lower)
        start, before = False, word
    return slots, values


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def window_hashes(slots: list[str], size: int, words: WordHashes) -> np.ndarray:
    """int64 hash of every window of ``size`` template words, in order."""
    n = len(slots) - size + 1
    if n < 1:
        return np.zeros(0, np.int64)
    return _combined(np.fromiter(map(words.__getitem__, slots), np.uint64, len(slots)), size).view(np.int64)


def _combined(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of ``size`` word hashes."""
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ h[k : n + k]) * np.uint64(_PRIME)
        out ^= out >> np.uint64(32)
    return out


class Vocabulary(dict):
    """Word -> its index in ``kind`` and ``hash``, so a batch of texts is canonicalised as arrays."""

    WORD, CAPITAL, NUMERIC, MEASURE, SIGN, END = range(6)

    def __init__(self):
        super().__init__()
        self.kind, self.hash = np.zeros(1024, np.int8), np.zeros(1024, np.uint64)

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k == len(self.kind):
            self.kind, self.hash = np.resize(self.kind, 2 * k), np.resize(self.hash, 2 * k)
        lower = word.lower()
        if word in _ENDS:
            kind = self.END
        elif word[0].isdigit() or lower in NUMBERS:
            kind = self.NUMERIC
        elif word in _SIGNS:
            kind = self.SIGN
        elif lower in UNITS:
            kind = self.MEASURE
        else:
            kind = self.CAPITAL if word[0].isupper() and not (len(word) > 1 and word.isupper()) else self.WORD
        self.kind[k], self.hash[k] = kind, xxhash.xxh3_64_intdigest(lower)
        self[word] = k
        return k

    def templates(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of the texts' template words (those of ``template``), and the text each belongs to."""
        if len(self) >= MEMO_WORDS:
            self.clear()
        found = [_TOKEN.findall(t) for t in texts]
        sizes = np.array([len(f) for f in found])
        ids = np.fromiter((self[w] for f in found for w in f), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        kind = self.kind[ids]
        start = np.ones(len(ids), bool)
        start[1:] = (kind[:-1] == self.END) | (doc[1:] != doc[:-1])
        real = kind != self.END
        kind, doc, start, h = kind[real], doc[real], start[real], self.hash[ids[real]]
        numeric = kind == self.NUMERIC
        after = np.zeros(len(kind), bool)
        after[1:] = numeric[:-1] & (doc[1:] == doc[:-1])
        beside = after.copy()
        beside[:-1] |= numeric[1:] & (doc[1:] == doc[:-1])
        unit = ((kind == self.SIGN) & beside) | ((kind == self.MEASURE) & after)
        capital = (kind == self.CAPITAL) & ~start
        for mask, slot in ((numeric, NUMBER), (unit, UNIT), (capital, NAME)):
            h[mask] = xxhash.xxh3_64_intdigest(slot)
        words = (kind != self.SIGN) | beside
        return h[words], doc[words]


def conflicts(pairs: dict[int, tuple[str, str, str]]) -> set[int]:
    """The places of an alignment whose (slot, item value, document value) departs from what most slots say."""
    there: dict[tuple[str, str], Counter] = defaultdict(Counter)
    back: dict[tuple[str, str], Counter] = defaultdict(Counter)
    for slot, a, b in pairs.values():
        there[slot, a][b] += 1
        back[slot, b][a] += 1

    def most(votes: Counter) -> str:
        return min(votes, key=lambda v: (-votes[v], v))

    return {at for at, (slot, a, b) in pairs.items() if most(there[slot, a]) != b or most(back[slot, b]) != a}


def _slots(slots: list[str], at: int, size: int) -> list[int]:
    return [k for k in range(at, at + size) if slots[k] in (NUMBER, NAME, UNIT)]


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """h, item_id, item (hash of the text), copies, item_words, p, size, and at, slots, item_vals of the placeholders of each window."""
    schema = "item_id long, item long, copies long, h long, item_words int, p int, size int, at array<int>, slots array<string>, item_vals array<string>"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 3 + [pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string())]

    def run(batches):
        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                for item_id, item, copies, text in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    slots, values = template(text)
                    size = min(window, len(slots))
                    for p, h in enumerate(window_hashes(slots, size, words).tolist() if size else ()):
                        own = _slots(slots, p, size)
                        rows.append((item_id, item, copies, h, len(slots), p, size, own, [slots[k] for k in own], [values[k] for k in own]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    text = F.coalesce("text", F.lit(""))
    own = items.groupBy("item_id", text.alias("text")).agg(F.count("*").alias("copies"))
    return own.select(F.col("item_id").cast("long"), F.xxhash64("text").alias("item"), "copies", "text").mapInArrow(run, schema)


def _bits(windows: DataFrame) -> np.ndarray:
    """BITS bools; the rows gathered are BITS / 63 at most."""
    place = F.explode(F.array(F.expr(f"h & {BITS - 1}L"), F.expr(f"shiftrightunsigned(h, 32) & {BITS - 1}L"))).alias("b")
    rows = windows.select(place).groupBy((F.col("b") % 63).alias("low"), F.floor(F.col("b") / 63).alias("cell")).count().groupBy("cell").agg(F.expr("bit_or(shiftleft(1L, int(low)))").alias("bits")).toArrow()
    table = np.zeros((BITS // 63 + 1, 63), bool)
    cells, bits = rows.column("cell").to_numpy(), rows.column("bits").to_numpy()
    for low in range(63):
        table[cells, low] = bits >> low & 1
    return table.reshape(-1)


class Held:
    """Finds the windows of texts that stand in the bit table."""

    def __init__(self, bits: np.ndarray, sizes: list[int]):
        self.bits, self.sizes = bits, sizes
        self.words, self.vocabulary = WordHashes(), Vocabulary()

    def _hits(self, h: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(self.bits[h & BITS - 1])
        return first[self.bits[h[first] >> 32 & BITS - 1]]

    def holders(self, texts: list[str]) -> list[int]:
        """Which of the texts hold some window."""
        slots, doc = self.vocabulary.templates(texts)
        found: set[int] = set()
        for size in self.sizes:
            n = len(slots) - size + 1
            if n >= 1:
                q = self._hits(_combined(slots, size).view(np.int64))
                found.update(doc[q[doc[q] == doc[q + size - 1]]].tolist())
        return sorted(found)

    def windows(self, text: str) -> list[tuple[int, int, list[str]]]:
        """(hash, place, values of the placeholders) of a text's windows."""
        slots, values = template(text)
        out = []
        for size in self.sizes:
            h = window_hashes(slots, size, self.words)
            out += [(int(h[q]), q, [values[k] for k in _slots(slots, q, size)]) for q in self._hits(h).tolist()]
        return out


def _held_windows(docs: DataFrame, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """k, z, th (the row's key), copies (rows of that key), w array<struct<h, q, vals>> of the documents that hold some window."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)  # BITS bytes

    def run(batches):
        held = Held(shared.value, sizes)
        kind = pa.list_(pa.struct([("h", pa.int64()), ("q", pa.int32()), ("vals", pa.list_(pa.string()))]))
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column(3).to_pylist()
                rows = held.holders(texts)
                if rows:
                    w = [[dict(zip(("h", "q", "vals"), x)) for x in held.windows(texts[k])] for k in rows]
                    own = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(w, kind)], ["k", "z", "th", "w"])

    found = keyed(docs).select("k", "z", "th", "text").mapInArrow(run, "k long, z boolean, th long, w array<struct<h: long, q: int, vals: array<string>>>")
    return found.groupBy("k", "z", "th").agg(F.count("*").alias("copies"), F.first("w").alias("w"))


def cover(windows: list[tuple[int, int, int, list[int], list[str], list[str], list[str]]]) -> tuple[int, int]:
    """(covered words, changed slots) by (shift, p, size, at, slots, item values, document values) of one document's windows and one item's."""
    shifts: dict[int, list] = defaultdict(list)
    for shift, *window in windows:
        shifts[shift].append(window)
    covered: set[int] = set()
    changed = 0
    for own in shifts.values():
        pairs = {k: pair for _, _, at, *values in own for k, *pair in zip(at, *values)}
        wrong = conflicts(pairs)
        counted: set[int] = set()
        for p, size, at, _, a, b in own:
            if a == b or wrong.isdisjoint(at):
                counted.update(range(p, p + size))
        covered |= counted
        changed = max(changed, sum(k in counted and k not in wrong and a != b for k, (_, a, b) in pairs.items()))
    return len(covered), changed


def _judged(key, table):
    rows = zip(*(table.column(c).to_pylist() for c in ("shift", "p", "size", "at", "slots", "item_vals", "vals")))
    words = table.column("item_words")[0].as_py()
    covered, changed = cover([r for r in rows if len(r[5]) == len(r[6])])
    keep = covered >= MIN_COVER * words
    out = {"k": key[0], "z": key[1], "th": key[2], "item_id": key[3], "copies": table.column("copies")[0]}
    numbers = {"covered_words": covered, "item_words": words, "changed_slots": changed}
    made = pa.table({c: pa.array([v.as_py()], v.type) for c, v in out.items()} | {c: pa.array([v], pa.int32()) for c, v in numbers.items()})
    return made if keep else made.slice(0, 0)


def _found(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """k, z, th, item_id, copies (pairs of rows), covered_words, item_words, changed_slots."""
    items = cut(item_windows(benchmark, window))
    sizes = sorted(r.size for r in items.select(F.col("size").alias("size")).distinct().collect())  # WINDOW rows at most
    held = _held_windows(docs, _bits(items), sizes)
    places = items.withColumnRenamed("copies", "item_copies")
    met = held.select("k", "z", "th", "copies", F.inline("w")).join(places, "h")
    met = met.withColumn("shift", F.col("q") - F.col("p")).withColumn("copies", F.col("copies") * F.col("item_copies")).drop("h", "q", "item_copies")
    schema = "k long, z boolean, th long, item_id long, copies long, covered_words int, item_words int, changed_slots int"
    return met.groupBy("k", "z", "th", "item_id", "item").applyInArrow(_judged, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, covered_words, item_words, changed_slots: one row for each item that a document holds."""
    found = _found(docs, benchmark, window).withColumn("row", F.explode(F.expr("array_repeat(1, int(copies))")))
    return found.select(F.when(~F.col("z"), F.col("k")).alias("doc_id"), "item_id", "covered_words", "item_words", "changed_slots")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) without the rows that hold a benchmark item."""
    bad = _found(docs, benchmark, WINDOW).select("k", "z", "th").distinct()
    columns = ("lang", "source", "n_chars")
    own = keyed(docs.withColumn("_text", F.col("text")), ("_text", *columns))
    return own.join(bad, ["k", "z", "th"], "left_anti").select("doc_id", F.col("_text").alias("text"), *columns)
