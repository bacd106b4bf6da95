"""Mapping freely typed values to a canonical list with BK-trees over its entries (problem 4)."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.words import LINKING, BKTree, EntryTree, Spellings, StringTree, fold, plural, singular, slips
from termloom.runtime import cut

#: A shard of the reference list holds at most so many entries; each shard is one closure of bounded size, and the driver holds one at a time.
SHARD_ENTRIES = 5_000
#: The distinct words of the whole reference list go to every task; lists with more are refused.
REFERENCE_WORDS = 200_000
#: Slips of the pen that a text may have in all, and the costs of a slip and of the ways of shortening a word.
SLIPS = 2
SLIP, SHORT, CONTRACTED, LOOSE = 1.2, 1.0, 2.0, 3.0
SLIPPED_SKELETON, SLIPPED_START, SLIPPED_CONTRACTION = 2.6, 2.8, 4.0

_IRI = re.compile(r"^[\s<\[({\"']*([A-Za-z][A-Za-z0-9+.-]*:\S*?)[\s>\])}\"']*$")
_AROUND = re.compile(r"[\s<>\[\](){}\"'\u200b\u200c\u200d\u2060\ufeff]")
_NUMBERED = re.compile(r"^\s*(?:[-*•–—·>#]+|\(?[0-9]+(?:\.[0-9]+)*\s*[.)]?|\(?[A-Za-z][.)]|\(?[ivxlcIVXLC]+[.)])\s+")
_WORD = re.compile(r"([a-z]+|[0-9]+)(\.?)")
_CAMEL = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])")
_PREDICATE = re.compile(r"^\s*[a-z]+:[a-z]+(?:[A-Z][a-z]*)*\s*$")
_SQUARE, _ROUND = re.compile(r"\[[^\]]*\]"), re.compile(r"\([^)]*\)")
_HEAD, _TAIL = re.compile(r"^[^:/>]*[:/>]"), re.compile(r"\s[-–—]\s[^-–—]*$")
_VOWELS = re.compile("[aeiou]")


def iri_tail(text: str) -> str:
    """The part after the last slash or colon, without brackets, blanks and closing slashes."""
    return re.split(r"[/:]", _AROUND.sub("", text.replace("\xa0", "")).rstrip("/:"))[-1]


def skeleton(word: str) -> str:
    """A word as it is shortened by leaving out its vowels but a first one."""
    return word[:1] + _VOWELS.sub("", word[1:])


def name_words(name: str) -> list[str]:
    """The words of a name in order, folded, without linking words."""
    return [w for w in re.findall("[a-z]+|[0-9]+", fold(name)) if w not in LINKING]


def _subsequence(short: str, word: str) -> bool:
    it = iter(word)
    return all(ch in it for ch in short)


class Reading:
    """What a typed token may stand for: ``known`` (it is a word of the reference list and stands only for itself), ``near`` (stems within the slips), ``short``
    (stems it shortens, with costs)."""

    __slots__ = ("known", "near", "short", "costs")

    def __init__(self, known: set[str], near: dict[str, int], short: dict[str, float]):
        self.known, self.near, self.short = known, near, short
        self.costs: dict[str, list[tuple[float, int]]] = {s: [(0.0, 0)] for s in known}
        for s, d in near.items():
            self.costs.setdefault(s, []).append((SLIP * d, d))
        for s, c in short.items():
            self.costs.setdefault(s, []).append((c, 0))


class Vocabulary:
    """The distinct words of the whole reference list: the same in every shard, so that no answer depends on how the list is cut."""

    def __init__(self, words: Iterable[str], letters: Iterable[str] = ()):
        forms: dict[str, set[str]] = {}
        for w in words:
            if not w.isdigit():
                s = singular(w)
                for f in (w, s, plural(s)):
                    forms.setdefault(f, set()).add(s)
        self.forms = forms
        self.sorted_forms = sorted(forms)
        self.longest = max(map(len, forms), default=0)
        self.stems = {s for x in forms.values() for s in x}
        self.spellings = Spellings(self.sorted_forms)
        self.skeletons: dict[str, set[str]] = {}
        for f, s in forms.items():
            self.skeletons.setdefault(skeleton(f), set()).update(s)
        self.bones = BKTree(sorted(k for k in self.skeletons if len(k) >= 5))
        self.by_initial: dict[str, list[str]] = {}
        for f in self.sorted_forms:
            self.by_initial.setdefault(f[0], []).append(f)
        self.mojibake: dict[str, str] = {}
        for ch in letters:
            for wrong in ("cp1252", "latin-1"):
                try:
                    seen = ch.encode("utf-8").decode(wrong)
                except UnicodeDecodeError:
                    continue
                self.mojibake[unicodedata.normalize("NFKC", seen.casefold())] = ch.casefold()
                self.mojibake[seen.casefold()] = ch.casefold()
        self.readings: dict[tuple[str, bool], Reading] = {}

    def repair(self, text: str) -> str:
        """Undoes letters that were decoded with the wrong table."""
        if text.isascii():
            return text
        low = text.casefold()
        if any(k in low for k in self.mojibake):
            for k, v in self.mojibake.items():
                if len(k) > 1:
                    low = low.replace(k, v)
            return low
        return text

    def read(self, word: str, dot: bool) -> Reading:
        got = self.readings.get((word, dot))
        if got is None:
            if len(self.readings) > 300_000:
                self.readings.clear()
            got = self.readings[word, dot] = self._read(word, dot)
        return got

    def _read(self, word: str, dot: bool) -> Reading:
        if word.isdigit():
            return Reading({word}, {}, {})
        stem = singular(word)
        if word in self.forms and not (dot and len(word) < 4):
            return Reading(self.forms[word], {}, {})
        if stem in self.stems:
            return Reading({stem}, {}, {})
        near: dict[str, int] = {}
        short: dict[str, float] = {}

        def put(stems, cost: float) -> None:
            for s in stems:
                if cost < short.get(s, 9.0):
                    short[s] = cost

        if len(word) >= 4:
            most = 1 if len(word) < 6 else SLIPS
            for i in np.nonzero(self.spellings.row(word) <= 2 * most)[0].tolist():
                f = self.sorted_forms[i]
                if (d := slips(word, f, most)) <= most:
                    for s in self.forms[f]:
                        near[s] = min(d, near.get(s, 9))
        if len(word) >= 2:
            put(self.skeletons.get(word, ()), SHORT)
        for w in {word, stem}:
            if len(w) >= (3 if dot else 4):
                i = bisect_left(self.sorted_forms, w)
                while i < len(self.sorted_forms) and self.sorted_forms[i].startswith(w):
                    put(self.forms[self.sorted_forms[i]], SHORT)
                    i += 1
        if len(stem) >= 2:
            for f in self.by_initial.get(stem[0], ()):
                if len(f) > len(stem) + 1 and _subsequence(stem, f):
                    put(self.forms[f], CONTRACTED if f[-1] == stem[-1] or f[-1] == "s" and f[-2] == stem[-1] else LOOSE)
        if min([SLIP * d for d in near.values()] + list(short.values()), default=9.0) > 2.5:
            for w in {word, stem}:
                if len(w) >= 4:
                    for _, k in self.bones.within(w, 1):
                        put(self.skeletons[k], SLIPPED_SKELETON)
                    for f in (f for ch in {w[0], w[1]} for f in self.by_initial.get(ch, ())):  # a shortened word with a slip
                        if len(f) > len(w) and slips(w, f[: len(w)], 1) <= 1 and (dot or len(w) >= 5):
                            put(self.forms[f], SLIPPED_START)
                    for f in self.by_initial.get(w[0], ()):
                        if len(f) > len(w) + 1 and (any(_subsequence(w[:i] + w[i + 1 :], f) for i in range(1, len(w))) or any(_subsequence(w[:i] + w[i + 1] + w[i] + w[i + 2 :], f) for i in range(1, len(w) - 1))):
                            put(self.forms[f], SLIPPED_CONTRACTION)
        return Reading(set(), near, short)

    def pieces(self, word: str) -> list[str] | None:
        """The words of a token that is several known words without gaps."""
        best: dict[int, list[str]] = {0: []}
        for i in range(len(word)):
            if i in best:
                for j in range(i + 2, min(len(word), i + self.longest) + 1):
                    w = word[i:j]
                    if (w in self.forms or (i and w in LINKING)) and (j not in best or len(best[j]) > len(best[i]) + 1):
                        best[j] = [*best[i], w]
        got = best.get(len(word))
        return got if got and len(got) > 1 else None

    def tokens(self, text: str) -> list[tuple[str, bool]]:
        out = []
        for w, dot in _WORD.findall(fold(_CAMEL.sub(" ", text))):
            if w in LINKING:
                continue
            parts = self.pieces(w) if len(w) >= 8 and w not in self.forms else None
            if parts:
                out += [(p, False) for p in parts if p not in LINKING]
            else:
                out.append((w, dot == "."))
        return out

    def _decorates(self, part: str, pattern) -> bool:
        """Whether a part only decorates: not all of its words name words of the reference list."""
        if pattern is _NUMBERED:
            return True
        named = 0
        for w, dot in self.tokens(part):
            r = self.read(w, dot)
            if w.isdigit() or not (r.known or any(d <= 1 for d in r.near.values()) or any(c <= SLIP for c in r.short.values())):
                return True
            named += 1
        return not named

    def variants(self, text: str) -> Iterator[str]:
        """The text, then without what decorates it: numbering, remarks, and what stands before a colon, slash or '>'."""
        seen = set()
        todo = [text]
        while todo:
            t = todo.pop(0)
            if t in seen:
                continue
            seen.add(t)
            yield t
            for pattern in (_NUMBERED, _SQUARE, _ROUND, _HEAD, _TAIL):
                m = pattern.search(t)
                if m and m.group().strip() and (rest := (t[: m.start()] + " " + t[m.end() :]).strip()) and self._decorates(m.group(), pattern):
                    todo.append(rest)


class Reference:
    """Search structures over one shard of the reference list: (iri, names of the entry).

    An entry is the multiset of its words' stems. BK-trees over the entries, one for each number of words, hold them under the order-free edit metric: the least
    number of letters to insert, lose or replace when the words of two entries are paired in the best way (Levenshtein distance as the ground metric). A text's
    tokens are paired the same way; the triangle inequality leaves out subtrees that can't hold an entry within the threshold, and every entry within it comes out.
    The exact check that follows demands that known words stand for themselves, that slips (a swap counts once) are two in all at most, and takes the
    cheapest entry. Text without any gap is searched as a whole in a BK-tree over the joined entries."""

    def __init__(self, entries: list[tuple[str, list[str]]], vocabulary: Vocabulary | None = None):
        if vocabulary is None:
            vocabulary = Vocabulary(*reference_words(n for _, names in entries for n in names))
        self.vocabulary = vocabulary
        self.by_tail: dict[str, str] = {}
        self.squashed: dict[str, str] = {}
        self.joined: dict[str, str] = {}
        by_words: dict[tuple, str] = {}
        for iri, names in entries:
            self._keep(self.by_tail, iri_tail(iri), iri)
            for name in names:
                words = name_words(name)
                if not words:
                    continue
                stems = [singular(w) for w in words]
                self._keep(by_words, tuple(sorted(stems)), iri)
                for order in (words, [words[-1], *words[:-1]]):
                    self._keep(self.joined, "".join(order), iri)
                for order in (words, [words[-1], *words[:-1]], [stems[-1], "of", *words[:-1]], [stems[-1], "for", *words[:-1]], [*words[:-1], stems[-1]]):
                    self._keep(self.squashed, "".join(order), iri)
        self.words = sorted({s for k in by_words for s in k})
        self.at = {w: i for i, w in enumerate(self.words)}
        self.spellings = Spellings(self.words)
        at = {f: i for i, f in enumerate(vocabulary.sorted_forms)}
        # where each word of the shard stands among those of the whole list; numbers stand nowhere there
        self.place = np.array([at.get(w, -1) for w in self.words], np.int64)
        self.numbers = np.flatnonzero(self.place < 0)
        self.trees: dict[int, EntryTree] = {}
        self.iris: dict[int, list[str]] = {}
        sizes: dict[int, list[tuple]] = {}
        for k in sorted(by_words):
            sizes.setdefault(len(k), []).append(k)
        for n, keys in sizes.items():
            self.trees[n] = EntryTree(np.array([[self.at[w] for w in k] for k in keys], np.int32), self.spellings)
            self.iris[n] = [by_words[k] for k in keys]
        self._joined: StringTree | None = None
        self.whole: dict[str, tuple[float, str] | None] = {}
        self.rows: dict[tuple[str, bool], tuple[np.ndarray, np.ndarray, int] | None] = {}
        self.asked: dict[tuple, tuple[float, str] | None] = {}
        self.texts: dict[str, tuple[float, int, str] | None] = {}

    @staticmethod
    def _keep(to: dict, key, iri: str) -> None:
        if key not in to or iri < to[key]:  # two entries with one name: the smaller IRI
            to[key] = iri

    def _far(self, word: str) -> np.ndarray:
        """Distances of a word to the words of the shard, out of those to all words of the list."""
        row = self.vocabulary.spellings.row(word)[self.place]
        row[self.numbers] = np.maximum(len(word), self.spellings.length[self.numbers])  # letters and digits have nothing in common
        return row

    def _row(self, token: tuple[str, bool]) -> tuple[np.ndarray, np.ndarray, int] | None:
        """Least and greatest distance of what a token may stand for to each word of the shard, and how far off the stems are that it may be a slip of. None
        where it can stand for no word of this shard."""
        if token in self.rows:
            return self.rows[token]
        if len(self.rows) * len(self.words) > 100_000_000:
            self.rows.clear()
        reading = self.vocabulary.read(*token)
        got = None
        if any(s in self.at for s in reading.costs):
            options = {s for s in (*reading.known, *reading.short) if s in self.at}
            reach = 0
            typed: set[str] = set()
            if reading.near:
                typed = {token[0], singular(token[0])}
                least = np.minimum.reduce([self._far(w) for w in typed])
                far = {s: int(least[self.at[s]]) for s in reading.near if s in self.at}
                options |= {s for s, d in far.items() if d > 2 * reading.near[s]}  # met through its plural only
                reach = max([d for s, d in far.items() if s not in options], default=0)
                if far:
                    options |= typed
            rows = [self._far(o) if o in typed else self.spellings.row(o) for o in options]
            got = (rows[0], rows[0], reach) if len(rows) == 1 else (np.minimum.reduce(rows), np.maximum.reduce(rows), reach)
        self.rows[token] = got
        return got

    def _cost(self, tokens: tuple, entry: list[int]) -> float | None:
        """The cost of reading the tokens as the words of an entry, or None: the best pairing with at most SLIPS slips in all."""
        words = [self.words[i] for i in entry]
        state: dict[tuple[int, int], float] = {(0, 0): 0.0}
        for t in tokens:
            costs = self.vocabulary.read(*t).costs
            after: dict[tuple[int, int], float] = {}
            for (mask, used), c in state.items():
                for j, w in enumerate(words):
                    if not mask >> j & 1:
                        for more, s in costs.get(w, ()):
                            if used + s <= SLIPS and c + more < after.get(key := (mask | 1 << j, used + s), 99.0):
                                after[key] = c + more
            state = after
        return min(state.values(), default=None)

    def _ask(self, queries: set[tuple]) -> None:
        """Answers all token multisets at once: (cost, iri) of the cheapest entry each may name."""
        if len(self.asked) > 300_000:
            self.asked.clear()
        groups: dict[int, list[tuple]] = {}
        for q in queries:
            if q not in self.asked:
                self.asked[q] = None
                if len(q) in self.trees and all(self._row(t) is not None for t in q):
                    groups.setdefault(len(q), []).append(q)
        for n, qs in groups.items():
            tokens = {t: i for i, t in enumerate(dict.fromkeys(t for q in qs for t in q))}
            rows = [self._row(t) for t in tokens]
            low, high = np.stack([r[0] for r in rows]), np.stack([r[1] for r in rows])
            ids = np.array([[tokens[t] for t in q] for q in qs], np.int32)
            radius = np.minimum(np.array([r[2] for r in rows], np.int32)[ids].sum(axis=1), 2 * SLIPS)
            for i, node in self.trees[n].within(low, high, ids, radius):
                cost = self._cost(qs[i], self.trees[n].entries[node].tolist())
                if cost is not None and (self.asked[qs[i]] is None or (cost, self.iris[n][node]) < self.asked[qs[i]]):
                    self.asked[qs[i]] = (cost, self.iris[n][node])

    def _ask_whole(self, words: set[str]) -> None:
        """Answers texts without gaps at once: the entry each names with at most two slips."""
        if len(self.whole) > 300_000:
            self.whole.clear()
        new = sorted(w for w in words if w not in self.whole)
        if not new:
            return
        if self._joined is None:
            self._joined = StringTree(sorted(self.joined))
        self.whole.update(dict.fromkeys(new))
        for w, e in self._joined.within(new, 2 * SLIPS):
            if (d := slips(w, e)) <= SLIPS:
                got = (SLIP * d + 0.5, self.joined[e])
                if self.whole[w] is None or got < self.whole[w]:
                    self.whole[w] = got

    def _by_iri(self, text: str) -> tuple[bool, str | None]:
        """Whether the text is to be judged as an IRI, and the entry that it names."""
        m = _IRI.match(text.replace("\xa0", " "))
        if m and (iri := self.by_tail.get(iri_tail(m.group(1)))) is not None:
            return True, iri
        if m and ("://" in text or _PREDICATE.match(text)):
            return True, None
        iri = self.by_tail.get(_AROUND.sub("", text))
        return iri is not None, iri

    def resolve_many(self, texts: Iterable[str]) -> dict[str, tuple[float, int, str] | None]:
        """For each text (cost, number of the variant, iri) of the entry it names, or None."""
        texts = set(texts)
        if len(self.texts) + len(texts) > 200_000:
            self.texts.clear()
        todo: dict[str, list[tuple[str, tuple]]] = {}
        longest = max(self.trees, default=0)
        for t in texts:
            if t in self.texts:
                continue
            self.texts[t] = None
            judged, iri = self._by_iri(t)
            if judged:
                self.texts[t] = None if iri is None else (0.0, 0, iri)
                continue
            todo[t] = []
            for v in self.vocabulary.variants(self.vocabulary.repair(t)):
                tokens = self.vocabulary.tokens(v)
                if tokens:
                    todo[t].append((v, tuple(sorted(tokens)) if len(tokens) <= longest else ()))
        self._ask({q for vs in todo.values() for _, q in vs if q})
        gapless = lambda q: len(q) == 1 and len(q[0][0]) >= 12 and not self.vocabulary.read(*q[0]).known and self.asked.get(q) is None
        self._ask_whole({q[0][0] for vs in todo.values() for _, q in vs if gapless(q)})
        for t, vs in todo.items():
            best = None
            for k, (v, q) in enumerate(vs):
                got = self.asked.get(q) if q else None
                if got is None or got[0] > 0:
                    if (iri := self.squashed.get(re.sub("[^a-z0-9]", "", fold(v)))) is not None:
                        got = (0.0, iri)
                    elif gapless(q):
                        got = self.whole[q[0][0]]
                if got is not None and (best is None or (got[0], k, got[1]) < best):
                    best = (got[0], k, got[1])
            self.texts[t] = best
        return {t: self.texts[t] for t in texts}

    def resolve(self, text: str) -> tuple[float, str] | None:
        """(cost, iri) of the entry the text names, or None."""
        got = self.resolve_many([text])[text]
        return None if got is None else (got[0], got[2])


def reference_words(names: Iterable[str]) -> tuple[set[str], set[str]]:
    """The distinct words of names, and their letters beyond ASCII."""
    words: set[str] = set()
    letters: set[str] = set()
    for n in names:
        words.update(name_words(n))
        if not n.isascii():
            letters.update(ch for ch in n if not ch.isascii() and ch.isalpha())
    return words, letters


def _shard(reference: DataFrame, k: int, parts: int, most: int) -> list[tuple[str, list[str]]]:
    part = reference if parts == 1 else reference.filter(F.pmod(F.xxhash64("iri"), F.lit(parts)) == k)
    rows = [(r.iri, [x for x in r.names if x and x.strip()]) for r in part.select("iri", "names").limit(4 * most + 17).collect()]
    if len(rows) > 4 * most + 16:  # shards hold half of ``most`` on average
        raise ValueError("a shard of the reference list is too large")
    return sorted(rows)


def entry_names(concepts: DataFrame) -> DataFrame:
    """iri, names of the entries of a concept table: label, preferred_label and alternative_labels."""
    names = F.array_distinct(F.array_compact(F.concat(F.array("label", "preferred_label"), F.coalesce("alternative_labels", F.array().cast("array<string>")))))
    return concepts.filter("iri is not null").select("iri", names.alias("names"))


_REFERENCES: dict[int, Reference] = {}


def resolve(texts: DataFrame, reference: DataFrame, most: int = SHARD_ENTRIES) -> DataFrame:
    """Adds iri, that of the entry which the column ``text`` names, or 'none'; other columns of ``texts`` stay, but for one called iri. A null or blank
    text names none. ``reference`` has iri and names (an array).

    The rows aren't shuffled: each task holds the trees of one shard of the reference list and remembers the texts it has met. A list of more than ``most`` entries is
    cut into shards by hash of the IRI; the rows pass one shard after the other, each keeping the cheapest answer so far (then the earlier variant of the text, then the
    smaller IRI). What a word may stand for is decided by the words of the whole list, so the answers don't depend on the shards."""
    others = [c for c in texts.columns if c not in ("text", "iri")]
    fields = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in others)
    n = reference.count()
    parts = 1 if n <= most else -(-n // max(1, most // 2))
    words: set[str] = set()
    letters: set[str] = set()
    for k in range(parts):
        for seen, new in zip((words, letters), reference_words(x for _, names in _shard(reference, k, parts, most) for x in names)):
            seen |= new
        if len(words) > REFERENCE_WORDS:
            raise ValueError("the reference list has too many words")
    sent = (sorted(words), sorted(letters))

    def against(state: DataFrame, entries: list) -> DataFrame:
        mark = hash((tuple((i, *x) for i, x in entries), len(sent[0])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ref = _REFERENCES.get(mark)
            if ref is None:
                _REFERENCES.clear()
                ref = _REFERENCES[mark] = Reference(entries, Vocabulary(*sent))
            for b in batches:
                asked, cost, variant, iri = (c.to_pylist() for c in b.columns[-4:])
                got = ref.resolve_many(t for t in asked if t and t.strip())
                best = [min((x for x in (got.get(t), None if c is None else (c, v, i)) if x is not None), default=(None, None, None)) for t, c, v, i in zip(asked, cost, variant, iri)]
                cols = [pa.array([x[j] for x in best], kind) for j, kind in enumerate((pa.float64(), pa.int32(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*b.columns[:-3], *cols], names=[*others, "_text", "_cost", "_variant", "_iri"])

        return state.mapInArrow(run, f"{fields}{', ' if others else ''}_text string, _cost double, _variant int, _iri string")

    none = [F.lit(None).cast(k).alias(c) for c, k in (("_cost", "double"), ("_variant", "int"), ("_iri", "string"))]
    state = texts.select(*others, F.col("text").alias("_text"), *none)
    for k in range(parts):
        state = against(state, _shard(reference, k, parts, most))
        if k < parts - 1:
            state = cut(state)
    return state.select(*others, F.coalesce("_iri", F.lit("none")).alias("iri"))


def found(values: DataFrame, proposals: DataFrame, concepts: DataFrame) -> DataFrame:
    """kind, row_id, iri for values and proposals without an iri whose text isn't blank. Of several rows of one id the latest holds
    (a null time is earliest; equal times: the greatest text). Rows without an id are left out."""

    def latest(df: DataFrame, kind: str, ident: str, text: str, time: str) -> DataFrame:
        one = df.filter(F.col(ident).isNotNull()).groupBy(F.col(ident).alias("row_id")).agg(F.max_by(F.struct(F.col(text).alias("text"), F.col("iri").alias("given")), F.struct(F.col(time), F.coalesce(F.col(text), F.lit("")))).alias("r"))
        blank = F.regexp_replace("r.text", r"[\s\p{Z}\p{Cf}\p{Cc}]", "")
        return one.filter(F.col("r.given").isNull() & (blank != "")).select(F.lit(kind).alias("kind"), "row_id", "r.text")

    texts = latest(values, "value", "value_id", "raw", "loaded_at").unionByName(latest(proposals, "proposal", "proposal_id", "label", "proposed_at"))
    # few bytes, much work: all cores take part, which adaptive coalescing would undo
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return resolve(texts.repartition(2 * cores, "kind", "row_id"), entry_names(concepts)).select("kind", "row_id", "iri")
