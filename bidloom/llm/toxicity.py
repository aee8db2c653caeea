"""Toxicity: Levenshtein automata over a lexicon trie, weighed by context.

The lexicon is learned from the labelled training rows: words, and word stems
of 4 to 6 letters, that toxic documents use and clean ones do not.  A word's
evidence is the number of distinct neighbour pairs it is seen with, and these
must be at least half its occurrences, so words of set phrases are no evidence.
Both are counted over distinct training texts: of equal texts and of near copies
of a class one is counted, so copies neither add evidence nor cancel it.
Lexicon and weights come from
at most MAX_ROWS labelled rows of each class (the smallest hashes of their ids:
a bounded, repeatable sample); scoring covers every row.

The lexicon becomes a trie.  A text's words are matched by walking the trie
with the rows of a Levenshtein automaton from its root, so any letter may be the
wrong one (one edit for terms of five letters or more, two from nine; a swap of
neighbours is one edit), and misspellings are met without a pass over the lexicon;
a term with words of clean training texts that near is only matched exactly.
Letters that look like digits or signs are folded first.  Around each match a
window of words decides its kind: quotation (quote marks about it, words of
reporting or denial) or address (second person, emphasis).  A logistic model
over the log counts of these kinds gives the score.

Defined results: null text counts as empty; texts without matches get the score
of no evidence (below 0.5); where the training rows lack a class the lexicon is
empty and every score is 0; repeated ids are independent rows, each labelled as
its id is; a row without an id is no training row and not held out; words of any
length are terms, but only those of five letters or more are met misspelt;
labels repeated for an id count as toxic if any of them is, null labels are no labels; an
empty table gives an empty table; lang, source and ids are never inputs.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidloom.llm.shared import cut

#: Labelled rows of each class that the lexicon and the weights are learned from, at most.
MAX_ROWS = {1: 5_000, 0: 10_000}
#: Evidence a term needs: contexts, forms of a stem, and what clean texts may have of it.
MIN_CONTEXTS, MIN_STEM_WORDS, MAX_CLEAN_SHARE = 3, 2, 0.02
WINDOW = 6
MEMO_WORDS = 300_000
#: With more alphabets among the terms than these, trying each costs more than the walk it saves.
MANY = 64
#: Terms of more letters than these are found by their thirds alone; they have too many forms with letters left out.
LONG = 24
#: Near copies among the training texts: bands of four least hashes of neighbour triples, and the share of bands met.
BANDS, BAND_ROWS, COPY_SHARE = 16, 4, 0.25
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Signs that stand for letters, and the words that tell quotation from address.
FOLD = str.maketrans("0134578@$!", "oieastbasi")
QUOTING = frozenset("quote quoted quotes said says wrote word words term called calling slur mean means never not sagte wort nannte nicht dit mot appelé jamais dijo palabra llamó nunca".split())
ADDRESS = frozenset("you your you're u ur yourself du dich dein ihr tu toi vous ton tú usted eres are so such total complete stupid damn bloody".split())
#: A word is group 1.  What else matches are runs without a word, taken whole so that none is read again from each of its signs.
_WORD = re.compile(r"([^\W\d_](?:[\w@$!]*[^\W_])?|[\w@$]*[^\W\d_][\w@$]*[^\W_])|[\d_@$]+")
_QUOTES = frozenset("\"“”«»„‘’'`")
#: A misspelt hit counts this much of a hit.
FUZZY = 0.75
FEATURES = ["hits", "quoted", "addressed"]
#: Where the training rows say nothing, the weights stay here; the last is the bias.
PRIOR = (2.0, -1.0, 0.3, -1.5)


def words(text: str) -> list[re.Match]:
    return [m for m in _WORD.finditer(text) if m[1]]


def tokens_of(text: str) -> list[str]:
    return [w for w in _WORD.findall(text) if w]


def letters(word: str) -> int:
    """The word's letters as bits; letters that share a bit only make it less telling."""
    out = 0
    for letter in word:
        out |= 1 << (ord(letter) & 63)
    return out


def thirds(term: str) -> set[tuple[int, str]]:
    """(place, text) of the thirds of a term, also with the letters at their borders swapped: two edits leave one of these whole, moved by two places at most."""
    a, b = len(term) // 3, 2 * len(term) // 3
    out: set[tuple[int, str]] = set()
    for swaps in ((), (a,), (b,), (a, b)):
        w = list(term)
        for i in swaps:
            w[i - 1], w[i] = w[i], w[i - 1]
        w = "".join(w)
        out |= {(0, w[:a]), (a, w[a:b]), (b, w[b:])}
    return out


def thinned(word: str, edits: int) -> set[str]:
    """The word, and what is left of it without any 1 to ``edits`` letters."""
    out = last = {word}
    for _ in range(edits):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


class Trie:
    """Nodes as dictionaries; '' marks the end of a whole term, '*' that of a stem."""

    def __init__(self, terms: list[tuple[str, str]]):
        self.root: dict = {}
        self.terms, self.by_edits = terms, None
        self.shortest = min((len(t) for t, _ in terms), default=0)
        self.longest = max((len(t) for t, _ in terms), default=0)
        for term, kind in terms:
            node = self.root
            for letter in term:
                node = node.setdefault(letter, {})
            node["*" if kind == "stem" else ""] = term

    def __reduce__(self):
        """Sent as its terms: nested nodes would be pickled as deep as the longest term."""
        return Trie, (self.terms,)

    def exact(self, word: str) -> str | None:
        """'exact', 'stem' or None: the longest walk of the word itself."""
        node, stem = self.root, None
        for letter in word:
            node = node.get(letter)
            if node is None:
                return stem
            if "*" in node:
                stem = "stem"
        return "exact" if "" in node else stem

    def near(self, word: str) -> set[str]:
        """The whole terms within their edits of ``word``: one for five letters or more, two from nine; a swap of neighbours is one.

        Words that share no form with letters left out with any term are never
        walked: a term within k edits has one in common, each with k left out at
        most; nor are words that lack, or have besides, more than k letters of every
        term, or, for two edits, that hold no third of a term.  Terms of over LONG
        letters have too many such forms; they are kept by their length, and those
        that are as long as the word but for two letters, and share a third with it
        in its place, are walked.
        """
        if self.by_edits is None:
            self.by_edits, self.long = [], {}
            for edits, lo, hi in ((1, 5, 9), (2, 9, LONG + 1)):
                own = [t for t in self.terms if lo <= len(t[0]) < hi]
                parts = {x for t, _ in own for _, x in thirds(t)} if edits == 2 else set()
                self.by_edits.append((edits, Trie(own), {letters(t) for t, _ in own}, parts, sorted({len(x) for x in parts}), set().union(*(thinned(t, edits) for t, _ in own))))
            for term in self.terms:
                if len(term[0]) > LONG:
                    self.long.setdefault(len(term[0]), []).append((term, thirds(term[0])))
        n, has = len(word), letters(word)
        found: set[str] = set()
        for edits, trie, alphabets, parts, sizes, forms in self.by_edits:
            if not trie.root or not trie.shortest - edits <= n <= trie.longest + edits:
                continue
            if len(alphabets) <= MANY and not any((a & ~has).bit_count() <= edits and (has & ~a).bit_count() <= edits for a in alphabets):
                continue
            if parts and not any(word[i : i + size] in parts for size in sizes for i in range(n - size + 1)) or forms.isdisjoint(thinned(word, edits)):
                continue
            found |= trie.walked(word, edits)
        if n > LONG - 2 and self.long:
            alike = [term for size in range(n - 2, n + 3) for term, parts in self.long.get(size, ()) if any(word.startswith(x, max(0, at + d)) for at, x in parts for d in range(-2, 3))]
            if alike:
                found |= Trie(alike).walked(word, 2)
        return found

    def walked(self, word: str, edits: int) -> set[str]:
        """The whole terms within ``edits`` of the word.

        The word's Levenshtein automaton advances with each letter of the trie,
        from its root.  Bit i of its k-th state tells that i letters of the word
        are read with at most k edits; a branch is left when no state is alive.
        A swap reads two letters at once: it goes on from the state before the
        last letter of the trie.
        """
        n = len(word)
        end, full = 1 << n, (2 << n) - 1
        masks: dict[str, int] = {}
        for letter in set(word):
            masks[letter] = int("".join("1" if x == letter else "0" for x in reversed(word)), 2)
        found: set[str] = set()
        start = [((2 << k) - 1) & full for k in range(edits + 1)]
        stack = [(self.root, start, [0] * (edits + 1), 0)]
        while stack:
            node, states, earlier, last = stack.pop()
            for letter, child in node.items():
                if letter == "":
                    if states[-1] & end:
                        found.add(child)
                elif letter != "*":
                    mask = masks.get(letter, 0)
                    below = states[0]
                    now = (below & mask) << 1
                    following = [now]
                    for k in range(1, edits + 1):
                        state = states[k]
                        swapped = ((earlier[k - 1] & mask) << 1 & last) << 1
                        now = ((state & mask) << 1 | below | below << 1 | now << 1 | swapped) & full
                        following.append(now)
                        below = state
                    if now:
                        stack.append((child, following, states, mask))
        return found


class Matcher(dict):
    """Word -> its kind of match, remembered for the words of a worker's texts."""

    def __init__(self, terms: list[tuple[str, str]]):
        super().__init__()
        self.trie = Trie(terms)
        self.fuzzy = Trie([t for t in terms if t[1] == "word"])

    def __missing__(self, word: str) -> str | None:
        kind = self.trie.exact(word)
        if kind is None:
            folded = word.translate(FOLD)
            folded = re.sub(r"(.)\1{2,}", r"\1", folded)
            if folded != word and (found := self.trie.exact(folded)):
                kind = "fuzzy" if found == "exact" else None
            if kind is None and len(folded) >= 4 and self.fuzzy.near(folded):
                kind = "fuzzy"
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = kind
        return kind

    def features(self, text: str) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        lower = text.lower()
        tokens = tokens_of(lower)
        kinds = [self[w] for w in tokens]
        if not any(kinds):
            return out
        spans = words(lower)
        for i, kind in enumerate(kinds):
            if not kind:
                continue
            out[0] += FUZZY if kind == "fuzzy" else 1
            near = tokens[max(0, i - WINDOW) : i] + tokens[i + 1 : i + 1 + WINDOW // 2]
            s, e = spans[i].span()
            marked = (lower[s - 1 : s] in _QUOTES and s > 0) or (lower[e : e + 1] in _QUOTES and e < len(lower))
            if marked or any(w in QUOTING for w in near):
                out[1] += 1
            elif any(w in ADDRESS for w in near):
                out[2] += 1
        return np.log1p(out)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic of the bounded sample of training rows."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out()).withColumn("h", F.xxhash64("doc_id"))
    parts = [known.filter(F.col("toxic") == y).orderBy("h", "doc_id").limit(MAX_ROWS[y]).select("doc_id", "toxic") for y in (0, 1)]
    # MAX_ROWS ids, by construction; the sample is read several times, the documents once.
    return cut(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(parts[0].union(parts[1])), "doc_id"))


def held_out():
    """Whether a row is kept from learning; one without an id is not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def bands(text: str) -> list[tuple[int, int]]:
    """(band, value) of a text's sketch: the least hashes of its neighbour triples in BANDS * BAND_ROWS buckets."""
    ids = np.array([xxhash.xxh3_64_intdigest(x) for x in ["", *tokens_of(text.lower()), ""]], np.uint64)
    if len(ids) < 3:
        return []
    h = ((ids[:-2] * _PRIME ^ ids[1:-1]) * _PRIME ^ ids[2:]) * _PRIME
    h ^= h >> np.uint64(31)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(least, (h % np.uint64(len(least))).astype(np.int64), h)
    empty = np.iinfo(np.uint64).max
    return [(i, xxhash.xxh3_64_intdigest(row.tobytes()) >> 1) for i, row in enumerate(least.reshape(BANDS, BAND_ROWS)) if (row != empty).any()]


def originals(sample: DataFrame) -> DataFrame:
    """text, toxic of the distinct texts: of a class's equal texts one, and no text that meets lesser hashes in COPY_SHARE of its bands."""
    texts = cut(sample.select("text", "toxic", F.xxhash64("text").alias("h")).dropDuplicates(["h", "toxic"]))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, y, b, v) for text, y, h in zip(*(c.to_pylist() for c in batch.columns)) for b, v in bands(text)]
            if rows:
                h, y, b, v = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(y, pa.int32()), pa.array(b, pa.int32()), pa.array(v, pa.int64())], ["h", "toxic", "band", "value"])

    met = texts.mapInArrow(sketched, "h long, toxic int, band int, value long")
    # BANDS rows a sampled text at most, by construction
    shared = met.groupBy("toxic", "band", "value").agg(F.min("h").alias("least"), F.count("*").alias("n")).filter("n > 1").drop("n")
    told = met.join(F.broadcast(shared), ["toxic", "band", "value"], "left").groupBy("h", "toxic").agg(F.count_if(F.col("h") > F.col("least")).alias("met"), F.count("*").alias("n"))
    copies = told.filter(F.col("met") >= COPY_SHARE * F.col("n")).select("h", "toxic")
    return texts.join(F.broadcast(copies), ["h", "toxic"], "left_anti").select("text", "toxic")


def lexicon(sample: DataFrame) -> list[tuple[str, str]]:
    """(term, kind) of all words and stems with enough evidence, most first; kind is word, plain (a word matched exactly only) or stem."""

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                rows: Counter = Counter()
                part = batch.slice(at, 128)
                for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    w = ["", *tokens_of(text.lower()), ""]
                    ids = [xxhash.xxh3_64_intdigest(x) for x in w]
                    rows.update((w[i], ((ids[i - 1] * 31 ^ ids[i + 1]) & (1 << 63) - 1), toxic) for i in range(1, len(w) - 1))
                if rows:
                    a, b, c = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(rows.values(), pa.int64())], ["word", "pair", "toxic", "n"])

    pairs = originals(sample).mapInArrow(neighbours, "word string, pair long, toxic int, n long").groupBy("word", "pair", "toxic").agg(F.sum("n").alias("n"))
    counts = cut(pairs.groupBy("word").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("seen")))
    n, bad, good = counts.agg(F.count("*"), F.sum("bad"), F.sum("good")).first()
    if not bad or not good:
        return []
    # So many contexts that of all words less than one would be toxic-only by chance.
    least = max(MIN_CONTEXTS, math.log(n) / math.log((bad + good) / bad))
    enough = (F.col("bad") >= least) & (F.col("good") <= MAX_CLEAN_SHARE * F.col("bad")) & (2 * F.col("bad") >= F.col("seen"))
    whole = counts.filter(enough).select("word", F.lit("word").alias("kind"), "bad")
    stems = counts.select("bad", "good", "seen", "word", F.explode(F.array([F.substring("word", 1, n) for n in (4, 5, 6, 7)])).alias("stem")).filter(F.length("word") > F.length("stem"))
    stems = stems.groupBy("stem").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.sum("seen").alias("seen"), F.count_if(F.col("bad") > 0).alias("forms")).filter(enough & (F.col("forms") >= MIN_STEM_WORDS) & (F.col("bad") >= 1.5 * least))
    best = whole.union(stems.select(F.col("stem").alias("word"), F.lit("stem").alias("kind"), "bad")).orderBy(F.desc("bad"), "word", "kind")  # words of MAX_ROWS rows, of which each takes several
    terms = [(r.word, r.kind) for r in best.collect()]
    fuzzy = Trie([t for t in terms if t[1] == "word"])

    def clashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [fuzzy.near(w) - {w} for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sorted(set().union(*near)), pa.string())], ["term"])

    plain = {r.term for r in counts.filter("good > 0").select("word").mapInArrow(clashes, "term string").distinct().collect()}
    return [(t, "plain" if kind == "word" and t in plain else kind) for t, kind in terms]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Logistic weights (the last one is the bias) by Newton steps with a ridge; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    prior = np.array(PRIOR)
    w = prior.copy()
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.full(len(w), 1.0)
        ridge[-1] = 0.01
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (p - y)) + ridge * (w - prior))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, terms: list[tuple[str, str]], weights: np.ndarray | None):
        self.terms, self.weights = terms, weights

    def scorer(self):
        matcher = Matcher(self.terms)

        def score(text: str) -> float:
            if self.weights is None:
                return 0.0
            return float(1 / (1 + np.exp(-np.clip(matcher.features(text) @ self.weights[:-1] + self.weights[-1], -30, 30))))

        return score


def train(docs: DataFrame, labels: DataFrame) -> Model:
    sample = labelled(docs, labels)
    terms = lexicon(sample)
    if not terms:
        return Model([], None)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms)
        for batch in batches:
            x = [matcher.features(t).tolist() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    # MAX_ROWS rows of three numbers, by construction; equal rows are counted, not sent.
    rows = sample.select("text", "toxic").mapInArrow(measured, "x array<double>, toxic int").groupBy("x", "toxic").count().collect()
    x, y, n = np.array([r.x for r in rows]), np.array([r.toxic for r in rows]), np.array([r["count"] for r in rows])
    if len(set(y.tolist())) < 2:
        return Model([], None)
    return Model(terms, fit(np.repeat(x, n, 0), np.repeat(y, n)))


_SCORERS: dict[str, object] = {}


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the kept columns, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the terms of MAX_ROWS rows
    key = uuid.uuid4().hex  # of this job: workers outlive jobs
    keep = keep or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = shared.value.scorer()
        scorer = _SCORERS[key]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                s = [scorer(t) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32())], [*part.schema.names[1:], "score", "predicted"])

    own = docs.select(F.coalesce("text", F.lit("")).alias("_text"), "doc_id", *keep)
    kinds = ", ".join(f"`{c}` {t}" for c, t in own.dtypes[1:])
    return own.mapInArrow(run, f"{kinds}, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return score(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source, n_chars) without those predicted toxic."""
    columns = ["text", "lang", "source", "n_chars"]
    return score(docs, train(docs, labels), columns).filter("predicted = 0").select("doc_id", *columns)
