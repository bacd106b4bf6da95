"""Encoding of a corpus with a public byte-level BPE tokenizer by merge replay (problem 6)."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from termloom.runtime import spread

#: Fixed values of the public tokenizer family: how a text falls into words before any merge.
WORDS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_PATH = "/opt/tokenizers/byte_bpe_50k.json"
#: A task handles its documents in blocks of so many characters, and forgets its pieces when it holds so many.
BLOCK_CHARS = 3_000_000
HELD_PIECES = 500_000


def _byte_letters() -> dict[str, int]:
    """The letters under which the vocabulary file writes the 256 bytes: printable ones as themselves, the others from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {chr(b): b for b in plain}, 256
    for b in range(256):
        if b not in plain:
            out[chr(extra)] = b
            extra += 1
    return out


class Merges:
    """Merge table: for each pair of ids its rank and the id it becomes; ids of the single bytes."""

    _loaded: dict[str, Merges] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, letters = model["vocab"], _byte_letters()
        self.byte_id = [0] * 256
        for ch, b in letters.items():
            self.byte_id[b] = vocab[ch]
        self.rank: dict[tuple[int, int], int] = {}
        self.pair: list[tuple[int, int]] = []
        self.becomes: list[int] = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            pair = (vocab[a], vocab[b])
            self.rank.setdefault(pair, len(self.pair))
            self.pair.append(pair)
            self.becomes.append(vocab[a + b])

    @classmethod
    def load(cls, path: str) -> Merges:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def replay(self, words: list[str]) -> list[list[int]]:
        """Ids of each word. All words lie in one array of symbols; an inverted index maps each pair that can merge to the
        positions where it stands. The merges come in rank order, each applied wherever its pair still stands, from left
        to right; only the neighbours of a merged place enter the index anew."""
        byte_id, rank, becomes, pairs = self.byte_id, self.rank, self.becomes, self.pair
        sym: list[int] = []
        starts = []
        for w in words:
            starts.append(len(sym))
            sym.extend([byte_id[b] for b in w.encode("utf-8", "surrogatepass")])
            sym.append(-1)  # the end of a word merges with nothing
        n = len(sym)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        index: dict[int, list[int]] = {}
        get = rank.get
        for i in range(n - 1):
            r = get((sym[i], sym[i + 1]))
            if r is not None:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
        queue = list(index)
        heapq.heapify(queue)
        while queue:
            r = heapq.heappop(queue)
            a, b = pairs[r]
            new = becomes[r]
            places = index.pop(r)
            places.sort()
            for i in places:
                j = after[i]
                if sym[i] != a or sym[j] != b:
                    continue
                sym[i], sym[j] = new, -2
                k = after[j]
                after[i] = k
                before[k] = i
                q = get((new, sym[k]))
                if q is not None:
                    if q in index:
                        index[q].append(i)
                    else:
                        index[q] = [i]
                        heapq.heappush(queue, q)
                h = before[i]
                if h >= 0:
                    q = get((sym[h], new))
                    if q is not None:
                        if q in index:
                            index[q].append(h)
                        else:
                            index[q] = [h]
                            heapq.heappush(queue, q)
        return [[s for s in sym[a:b] if s >= 0] for a, b in zip(starts, [*starts[1:], n])]


class PieceIds:
    """The ids of all pieces of text a task has met. A piece is what stands between two single blanks that have plain
    characters on both sides: there a word always begins, so pieces can be encoded apart. New pieces of a block fall into
    words, and the new words are replayed together."""

    _loaded: dict[str, PieceIds] = {}

    def __init__(self, path: str, held: int = HELD_PIECES):
        self.merges, self.held = Merges.load(path), held
        self.find = regex.compile(WORDS).findall
        self.split = re.compile(r"(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])").split
        self._clear()

    @classmethod
    def load(cls, path: str) -> PieceIds:
        """One for all tasks that a Python worker runs one after the other."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _clear(self) -> None:
        self.at: dict[str, int] = {}  # pieces after a blank
        self.at_first: dict[str, int] = {}  # pieces that begin a text
        self.word_ids: dict[str, list[int]] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.used = self.known = 0

    def learn(self, later: list[str], first: list[str]) -> None:
        word_ids = self.word_ids
        lists = [self.find(" " + p) for p in later] + [self.find(p) for p in first]
        new = [w for w in set().union(*lists) if w not in word_ids]
        for w, ids in zip(new, self.merges.replay(new)):
            word_ids[w] = ids
        got = [[x for w in words for x in word_ids[w]] for words in lists]
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter((x for g in got for x in g), np.int32, int(lengths.sum()))
        n = self.known
        while n + len(got) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[n : n + len(got)] = self.used + np.cumsum(lengths) - lengths
        self.length[n : n + len(got)] = lengths
        self.used += len(flat)
        self.at.update(zip(later, range(n, n + len(later))))
        self.at_first.update(zip(first, range(n + len(later), n + len(got))))
        self.known += len(got)

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For the texts of a block: the numbers of all their pieces in a row, and how many pieces each has (one at least)."""
        lists = [self.split(t) for t in texts]
        firsts = [p.pop(0) for p in lists]
        fresh, fresh_first = set().union(*lists), set(firsts)
        if self.known + len(fresh) + len(fresh_first) > self.held or len(self.word_ids) > self.held or self.used > 40 * self.held:
            self._clear()
        later, first = [p for p in fresh if p not in self.at], [p for p in fresh_first if p not in self.at_first]
        if later or first:
            self.learn(later, first)
        counts = np.fromiter(map(len, lists), np.int64, len(lists)) + 1
        at, at_first = self.at.__getitem__, self.at_first.__getitem__
        numbers = np.fromiter(chain.from_iterable(chain((at_first(f),), map(at, p)) for f, p in zip(firsts, lists)), np.int64, int(counts.sum()))
        return numbers, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and the offsets where each text begins."""
        numbers, counts = self.pieces(texts)
        lengths = self.length[numbers]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.ids[np.repeat(self.start[numbers] - (ends - lengths), lengths) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return flat, bounds


def blocks(batches: Iterator[pa.RecordBatch], chars: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """Arrow batches (key, text) cut so that each holds about ``chars`` characters, a longer text alone."""
    for b in batches:
        lengths = pa.compute.fill_null(pa.compute.utf8_length(b.column(1)), 0).to_numpy(zero_copy_only=False)
        first, held = 0, 0
        for i, n in enumerate(lengths):
            if held and held + n > chars:
                yield b.slice(first, i - first)
                first, held = i, 0
            held += int(n)
        if first < b.num_rows:
            yield b.slice(first)


def encode_corpus(docs: DataFrame, path: str = DEFAULT_PATH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ids: the token ids of every document without special tokens. A null or empty text has the empty list; strings
    of special tokens in a text are ordinary text. One row per input row, without a shuffle: each task replays the merges over the
    distinct words of its part of the corpus, in blocks, and writes ids from that index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = PieceIds.load(path)
        for b in blocks(batches):
            flat, bounds = words.encode([t or "" for t in b.column(1).to_pylist()])
            ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[key, "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return spread(docs.select(key, text)).mapInArrow(run, f"{key} {kind}, ids array<int>")
