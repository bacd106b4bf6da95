"""Relevance of many terms against a whole catalog: the score of functions/scoring.py, computed for all concepts of a block at once."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.functions.scoring import SPECIFICITY
from termloom.functions.text import STOPWORDS

#: Concepts that a task holds at a time; larger catalogs are taken block after block and the blocks' winners are merged.
BLOCK_CONCEPTS = 20_000

_STOP = frozenset(STOPWORDS)
_RUNS = re.compile("[a-zA-Z]+")
_BLANKS = " \t\n\x0b\x0c\r" + "".join(chr(i) for i in range(0x3001) if unicodedata.category(chr(i)).startswith("Z"))


def content(text: str | None) -> list[str]:
    """Content words of a text, distinct and sorted, as functions/text.content_words has them."""
    return sorted({w for r in _RUNS.findall(text or "") if len(w := r.lower()) >= 2 and w not in _STOP})


def credit(a: str, b: str) -> float:
    """What one word is worth for another, as functions/scoring.word_credit has it."""
    if a == b:
        return 1.0
    short = min(len(a), len(b))
    if short >= 3 and (a.startswith(b) or b.startswith(a)):
        return 0.8
    k = max(4, (short * 7 + 9) // 10)
    return 0.7 if short >= 5 and a[:k] == b[:k] else 0.0


class _Fields:
    """One kind of text of all concepts (or several texts of one, as with synonyms): the words of each, and for each word the texts that hold it."""

    def __init__(self, texts: list[str | None], owners: list[int], vocabulary: dict[str, int]):
        words = [[vocabulary.setdefault(w, len(vocabulary)) for w in content(t)] for t in texts]
        self.owner = np.array(owners, np.int64)
        self.size = np.array([len(w) for w in words], np.int64)
        self.words = np.full((len(texts), max(map(len, words), default=0)), -1, np.int64)
        holds: dict[int, list[int]] = {}
        for i, ws in enumerate(words):
            self.words[i, : len(ws)] = ws
            for w in ws:
                holds.setdefault(w, []).append(i)
        self.holds = {w: np.array(at, np.int64) for w, at in holds.items()}

    def overlap(self, credits: list[dict[int, float]], best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts with any overlap and its size. ``credits``: for each query word, in order, what it is worth for each word it meets; ``best``: the
        most that any query word is worth for each word. Sums run in word order, as float addition demands."""
        forth = np.zeros(len(self.size))
        for row in credits:
            most = np.zeros(len(self.size))
            for w, c in row.items():
                if (at := self.holds.get(w)) is not None:
                    most[at] = np.maximum(most[at], c)
            forth += most
        hit = np.flatnonzero(forth)
        forth = forth[hit] / max(len(credits), 1)
        back = np.zeros(len(hit))
        if len(hit):
            rows = self.words[hit]
            for j in range(rows.shape[1]):
                back += best[rows[:, j]]  # the last entry, -1, is no word and worth nothing
            back = np.where(self.size[hit] >= 2, back / np.maximum(self.size[hit], 1) * 0.75, 0.0)
        return hit, np.maximum(forth, back)


class _Texts:
    """All texts of one kind in a row, to find those that hold a string."""

    def __init__(self, texts: list[str]):
        self.all = "\x00" + "\x00".join(texts) + "\x00"
        self.ends = np.cumsum([len(t) + 1 for t in texts]).tolist()

    def holding(self, part: str) -> list[int]:
        out, at = [], self.all.find(part)
        while at >= 0:
            i = bisect_right(self.ends, at - 1)
            out.append(i)
            at = self.all.find(part, self.ends[i])
        return out


class Block:
    """A block of concepts: (iri, label, definition, synonyms, preferred label)."""

    def __init__(self, rows: list[tuple]):
        rows = sorted(rows, key=lambda r: r[0])
        self.iris = [r[0] for r in rows]
        self.at = {iri: i for i, iri in enumerate(self.iris)}
        n = len(rows)
        low = [(r[1] or "").lower() for r in rows]
        self.low, self.named = low, np.array([bool(x) for x in low])
        self.preferred = [(r[4] or "").lower() for r in rows]
        synonyms = [(s, i) for i, r in enumerate(rows) for s in r[3] or [] if s is not None]
        vocabulary: dict[str, int] = {}
        self.label_words = _Fields([r[1] for r in rows], list(range(n)), vocabulary)
        self.preferred_words = _Fields([r[4] for r in rows], list(range(n)), vocabulary)
        self.definition_words = _Fields([r[2] for r in rows], list(range(n)), vocabulary)
        self.synonym_words = _Fields([s for s, _ in synonyms], [i for _, i in synonyms], vocabulary)
        self.vocabulary = vocabulary
        self.starts: dict[str, list[str]] = {}
        for w in vocabulary:
            self.starts.setdefault(w[:3], []).append(w)
        self.labels, self.preferreds, self.definitions = _Texts(low), _Texts(self.preferred), _Texts([(r[2] or "").lower() for r in rows])
        self.by_label: dict[str, list[int]] = {}
        for i, x in enumerate(low):
            if len(x) >= 4:
                self.by_label.setdefault(x, []).append(i)
        self.lengths = sorted({len(x) for x in self.by_label})
        self.equal: dict[str, list[int]] = {}
        for i, x in enumerate(low):
            self.equal.setdefault(x, []).append(i)
        self.credits: dict[str, dict[int, float]] = {}

    def _credits(self, word: str) -> dict[int, float]:
        got = self.credits.get(word)
        if got is None:
            if len(self.credits) > 200_000:
                self.credits.clear()
            got = {self.vocabulary[w]: c for w in self.starts.get(word[:3], ()) if (c := credit(word, w)) > 0}
            self.credits[word] = got
        return got

    def scores(self, query: str | None, words: list[str] | None = None, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the concepts that score above 0 for a query, and their scores. ``words`` may replace its content words."""
        q = (query or "").lower().strip(_BLANKS)
        qc = content(query) if words is None else sorted(words)
        n = len(self.iris)
        credits = [self._credits(w) for w in qc]
        best = np.zeros(len(self.vocabulary) + 1)
        for row in credits:
            for w, c in row.items():
                if c > best[w]:
                    best[w] = c
        label, preferred, synonym, definition = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        hit, o = self.label_words.overlap(credits, best)
        label[hit] = o * 88.0
        hit, o = self.preferred_words.overlap(credits, best)
        preferred[hit] = o * 86.0
        hit, o = self.definition_words.overlap(credits, best)
        definition[hit] = o * 55.0
        hit, o = self.synonym_words.overlap(credits, best)
        np.maximum.at(synonym, self.synonym_words.owner[hit], o * 82.0)
        if len(q) >= 4:
            inside = self.labels.holding(q)
            label[inside] = np.maximum(label[inside], 92.0)
            preferred[self.preferreds.holding(q)] = 84.0
        around: set[int] = set()
        for size in self.lengths:
            if size > len(q):
                break
            if size / len(q) > 0.3:
                for a in range(len(q) - size + 1):
                    around.update(self.by_label.get(q[a : a + size], ()))
        if around:
            at = np.array(sorted(around), np.int64)
            label[at] = np.maximum(label[at], 88.0)
        if q:
            held = self.definitions.holding(q)
            definition[held] = np.maximum(definition[held], 60.0)
            preferred[[i for i in self.preferreds.holding(q) if self.preferred[i] == q]] = 90.0
        primary = np.maximum(np.maximum(label, preferred), synonym)
        final = np.where(primary > 0, primary + np.minimum(definition * 0.12, 8.0), definition)
        shared = np.zeros(n)
        for w in qc:
            if (at := self.label_words.holds.get(self.vocabulary.get(w, -1))) is not None:
                shared[at] += 1
        size = self.label_words.size
        extra = size - shared
        cut = (size > 0) & (len(qc) > 0) & (final > 0) & (extra > 0) & (size > len(qc))
        final = final * np.where(cut, 1.0 - np.clip(extra / np.maximum(size, 1) * (SPECIFICITY * penalty), 0.0, 1.0), 1.0)
        final = np.minimum(final, 99.0)
        final[self.equal.get(q, [])] = 99.0
        final = np.where(self.named, np.floor(final * 10 + 0.5) / 10.0, 0.0)
        found = np.flatnonzero(final > 0)
        return found, final[found]


_BLOCKS: dict[int, Block] = {}


def _held(rows: list[tuple]) -> Block:
    mark = hash(tuple((r[0], r[1], r[2], tuple(r[3] or ()), r[4]) for r in rows))
    if mark not in _BLOCKS:
        while len(_BLOCKS) > 3:
            _BLOCKS.pop(next(iter(_BLOCKS)))
        _BLOCKS[mark] = Block(rows)
    return _BLOCKS[mark]


def _parts(concepts: DataFrame, most: int) -> Iterator[list[tuple]]:
    """The catalog in blocks of bounded size by hash of the IRI, read one at a time."""
    n = concepts.count()
    parts = 1 if n <= most else -(-2 * n // most)
    for k in range(parts):
        part = concepts if parts == 1 else concepts.filter(F.pmod(F.xxhash64("iri"), F.lit(parts)) == k)
        rows = [tuple(r) for r in part.select("iri", "label", "definition", "alternative_labels", "preferred_label").limit(2 * most + 65).collect()]
        if len(rows) > 2 * most + 64:
            raise ValueError("a block of the catalog is too large")
        if rows:
            yield rows


def _spread(df: DataFrame) -> DataFrame:
    """Few bytes, much work: over twice as many tasks as there are cores."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def best_concepts(terms: DataFrame, concepts: DataFrame, k: int, penalty: float = 1.0, most: int = BLOCK_CONCEPTS) -> DataFrame:
    """term, iri, label, branch, score, place: the k best concepts of each distinct term, score descending, then iri. Blank and null terms find nothing.

    Each task holds a block of the catalog as arrays and scores all of it for each term; a catalog of several blocks is scanned once for each, and the blocks'
    winners are merged by a window."""
    t = _spread(terms.select("term").filter(F.regexp_replace("term", r"[\s\p{Z}]", "") != "").distinct())

    def against(rows: list[tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _held(rows)
            for b in batches:
                cols: list[list] = [[], [], [], []]
                for term in b.column(0).to_pylist():
                    at, score = block.scores(term, penalty=penalty)
                    order = np.argsort(-score, kind="stable")[:k]  # concepts lie in order of their iris
                    cols[0] += [term] * len(order)
                    cols[1] += [block.iris[i] for i in at[order]]
                    cols[2] += score[order].tolist()
                    cols[3] += range(1, len(order) + 1)
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.string(), pa.string(), pa.float64(), pa.int32()))], names=["term", "iri", "score", "place"])

        return t.mapInArrow(run, "term string, iri string, score double, place int")

    found = [against(rows) for rows in _parts(concepts, most)]
    if not found:
        found = [t.select("term", F.lit(None).cast("string").alias("iri"), F.lit(0.0).alias("score"), F.lit(0).alias("place")).filter("false")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    if len(found) > 1:
        w = Window.partitionBy("term").orderBy(F.col("score").desc(), "iri")
        out = out.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
    return out.join(concepts.select("iri", "label", "branch"), "iri").select("term", "iri", "label", "branch", "score", "place")


def score_lists(asked: DataFrame, concepts: DataFrame, most: int = BLOCK_CONCEPTS) -> DataFrame:
    """term, iri, score of rows (term, queries, iris): the best score of each listed concept over the row's queries (an array of structs q, content)."""

    def against(rows: list[tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = _held(rows)
            for b in batches:
                cols: list[list] = [[], [], []]
                for term, queries, iris in zip(*(c.to_pylist() for c in b.columns)):
                    here = [(iri, block.at[iri]) for iri in iris if iri in block.at]
                    if here:
                        most_ = np.zeros(len(block.iris))
                        for q in queries:
                            at, score = block.scores(q["q"], q["content"])
                            most_[at] = np.maximum(most_[at], score)
                        for iri, i in here:
                            if most_[i] > 0:
                                for c, v in zip(cols, (term, iri, float(most_[i]))):
                                    c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.string(), pa.string(), pa.float64()))], names=["term", "iri", "score"])

        return _spread(asked.select("term", "queries", "iris")).mapInArrow(run, "term string, iri string, score double")

    out = None
    for rows in _parts(concepts, most):
        part = against(rows)
        out = part if out is None else out.unionByName(part)
    return asked.select("term", F.lit("").alias("iri"), F.lit(0.0).alias("score")).filter("false") if out is None else out
