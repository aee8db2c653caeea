"""Fill-in-the-middle examples cut by succinct rank and select.

A batch of texts is one run of UTF-8 bytes with two packed bitvectors over it: one
marks the last byte of each line, the other the first byte of each code point.
Both carry a directory of popcounts, one a block of 64 bytes.  The lines of a text
are the popcount over its bytes; the k-th line ends where ``select`` finds the
k-th mark, and characters of a part are a difference of two ranks, so no text is
ever split into lines or decoded.

Which lines a document is cut at and the order of its parts follow from a digest of its
id alone, so a job that runs again, or on other partitions, makes the same examples.

One map without a shuffle; a task holds one Arrow batch and its examples.

Defined results: null text counts as empty; a null id is digested as no digits;
texts that are empty or hold one of the marks stay plain, with null lengths; a
text of one line is cut before or after it; texts of any length are read whole;
each input row, also a repeated one, gives one row; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK = 64  # bytes of text per entry of a directory
YIELD_BYTES = 32 << 20


class Bits:
    """A packed bitvector with a popcount directory: rank and select of many places at once."""

    def __init__(self, marks: np.ndarray):
        padded = np.zeros(-(-max(len(marks), 1) // BLOCK) * BLOCK, bool)
        padded[: len(marks)] = marks
        self.words = np.packbits(padded, bitorder="little").view("<u8")  # one word a block
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marks before each place."""
        block, low = at // BLOCK, (at % BLOCK).astype(np.uint64)
        word = np.append(self.words, np.uint64(0))[block]
        return self.before[block] + np.bitwise_count(word & ((np.uint64(1) << low) - np.uint64(1)))

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th mark (from 1) for each k."""
        block = np.searchsorted(self.before, k, side="left") - 1
        word, rest = self.words[block], (k - self.before[block]).astype(np.uint64)
        place = np.zeros(len(k), np.uint64)
        for width in (32, 16, 8, 4, 2, 1):  # halves the word: into the upper half where the lower one holds too few
            lower = np.bitwise_count((word >> place) & np.uint64((1 << width) - 1)).astype(np.uint64)
            up = rest > lower
            rest, place = np.where(up, rest - lower, rest), np.where(up, place + np.uint64(width), place)
        return block * BLOCK + place.astype(np.int64)


def line_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Marks the last byte of each line of each text; a text's last byte ends its last line."""
    marks = data == 10
    ends = offsets[1:][offsets[1:] > offsets[:-1]]
    marks[ends - 1] = True
    return marks


def draws(ids: list[int | None], seed: int) -> np.ndarray:
    """uint32 (rows, 4): the first four 8-digit groups of sha256(seed:id)."""
    digests = [hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids]
    return np.frombuffer(b"".join(digests), ">u4").reshape(-1, 4).astype(np.int64)


def _arranged(seed: int, rate: int, spm_rate: int):
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            _, offsets, data = texts.buffers()
            offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            view = memoryview(data)[offsets[0] : offsets[-1]] if data is not None else memoryview(b"")
            offsets = offsets - offsets[0]
            raw = np.frombuffer(view, np.uint8)
            lines, chars = Bits(line_ends(raw, offsets)), Bits((raw & 0xC0) != 0x80)
            first = lines.rank(offsets[:-1])
            n = lines.rank(offsets[1:]) - first
            h = draws(batch.column(0).to_pylist(), seed)
            one, two = h[:, 0] % (n + 1), h[:, 1] % (n + 1)
            cuts = []
            for k in (np.minimum(one, two), np.maximum(one, two)):
                at, some = offsets[:-1].copy(), k > 0
                at[some] = lines.select((first + k)[some]) + 1
                cuts.append(at)
            seen = [chars.rank(at) for at in (offsets[:-1], *cuts)]
            forms, kept, made, size, begun = [], [], [], 0, 0

            def flush(end: int, begun: int, n=n, seen=seen, batch=batch) -> pa.RecordBatch:
                lengths = [pa.array(seen[j + 1][begun:end] - seen[j][begun:end], pa.int64(), mask=np.array(kept)) for j in (0, 1)]
                columns = [batch.column(0).slice(begun, end - begun), pa.array(n[begun:end], pa.int64()), pa.array(forms), *lengths, pa.array(made, pa.binary()).cast(pa.string())]
                return pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

            for i, (start, end, a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), cuts[0].tolist(), cuts[1].tolist())):
                text = bytes(view[start:end])
                if not text or h[i, 2] % 100 >= rate or any(m in text for m in marks):
                    form, out = "plain", text
                else:
                    p, m, s = marks[0] + text[: a - start], marks[2] + text[a - start : b - start], marks[1] + text[b - start :]
                    form, out = ("spm", s + p + m) if h[i, 3] % 100 < spm_rate else ("psm", p + s + m)
                forms.append(form), kept.append(form == "plain"), made.append(out)
                size += len(out)
                if size >= YIELD_BYTES:
                    yield flush(i + 1, begun)
                    forms, kept, made, size, begun = [], [], [], 0, i + 1
            if made:
                yield flush(batch.num_rows, begun)

    return run


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of each row: rate percent are cut, spm_rate percent of these put the suffix first."""
    own = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return own.mapInArrow(_arranged(seed, rate, spm_rate), f"doc_id {dict(own.dtypes)['doc_id']}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of.  A cut text holds none of the marks, so the first of each is the one that was put in."""

    def after(mark: str, *until: str) -> Column:
        rest = F.substring(output, F.locate(mark, output) + len(mark), F.length(output))
        for u in until:
            rest = F.substring_index(rest, u, 1)
        return rest

    psm = F.concat(after(PREFIX, SUFFIX), after(MIDDLE), after(SUFFIX, MIDDLE))
    spm = F.concat(after(PREFIX, MIDDLE), after(MIDDLE), after(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """The examples of ``docs`` with the digests of the output and of the text read back from it, in place of the output."""
    made = transform(docs)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_SQL = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT doc_id, text, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4,
    regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS lines FROM t
), c AS (
  SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle, array_to_string(lines[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
