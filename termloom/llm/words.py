"""Word forms, edit distances and BK-trees for freely typed text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np

#: Small linking words that carry no meaning in a heading.
LINKING = frozenset("a an and at by for from in of on or re the to with".split())
_ZERO = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")
_EXTRA = str.maketrans({"ø": "o", "ß": "ss", "æ": "ae", "œ": "oe", "đ": "d", "ł": "l", "ð": "d", "þ": "th", "ı": "i"})


def fold(text: str) -> str:
    """Lower case without accents, compatibility forms and invisible characters."""
    if text.isascii():
        return text.lower()
    s = unicodedata.normalize("NFKD", _ZERO.sub("", text)).casefold()
    return "".join(ch for ch in unicodedata.normalize("NFKD", s) if not unicodedata.combining(ch)).translate(_EXTRA)


def singular(word: str) -> str:
    if len(word) > 4 and word.endswith("ies"):
        return word[:-3] + "y"
    if len(word) > 4 and word.endswith(("sses", "xes", "ches", "shes")):
        return word[:-2]
    if len(word) > 3 and word.endswith("s") and not word.endswith("ss"):
        return word[:-1]
    return word


def plural(word: str) -> str:
    if word.endswith("y") and len(word) > 2 and word[-2] not in "aeiou":
        return word[:-1] + "ies"
    return word + ("es" if word.endswith(("ss", "x", "ch", "sh")) else "s")


def edits(a: str, b: str) -> int:
    """Levenshtein distance, a true metric, with one machine word per row of the table (bits of a long integer)."""
    if a == b:
        return 0
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | (1 << i)
    n = len(a)
    full, last = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    for ch in b:
        eq = at.get(ch, 0)
        x = eq | down
        eq |= ((eq & up) + up) ^ up
        more, less = down | ~(eq | up), up & eq
        if more & last:
            score += 1
        if less & last:
            score -= 1
        more = (more << 1) | 1
        less <<= 1
        up = (less | ~(x | more)) & full
        down = more & x & full
    return score


def slips(a: str, b: str, most: int = 2) -> int:
    """Slips of the pen between two words: insertions, losses, replacements and swaps of neighbours; most + 1 stands for more."""
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return most + 1
    far = most + 1
    before, row = None, list(range(lb + 1))
    for i in range(1, la + 1):
        x = a[i - 1]
        new = [far] * (lb + 1)
        if i <= most:
            new[0] = i
        for j in range(max(1, i - most), min(lb, i + most) + 1):  # cells further from the diagonal hold more anyway
            y = b[j - 1]
            v = row[j - 1] + (x != y)
            if row[j] + 1 < v:
                v = row[j] + 1
            if new[j - 1] + 1 < v:
                v = new[j - 1] + 1
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2] and before[j - 2] + 1 < v:
                v = before[j - 2] + 1
            new[j] = v if v < far else far
        if min(new) > most:
            return far
        before, row = row, new
    return min(row[lb], far)


class BKTree:
    """Words under Levenshtein distance; a child edge holds its distance to the parent, so that by the triangle inequality
    only edges within ``radius`` of the query's own distance can lead to an answer."""

    def __init__(self, words):
        self.root: list | None = None
        for w in words:
            self.add(w)

    def add(self, word: str) -> None:
        if self.root is None:
            self.root = [word, {}]
            return
        node = self.root
        while True:
            d = edits(word, node[0])
            if d == 0:
                return
            nxt = node[1].get(d)
            if nxt is None:
                node[1][d] = [word, {}]
                return
            node = nxt

    def within(self, word: str, radius: int) -> list[tuple[int, str]]:
        """All words at most ``radius`` away with their distances."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            w, below = todo.pop()
            d = edits(word, w)
            if d <= radius:
                found.append((d, w))
            for k, child in below.items():
                if d - radius <= k <= d + radius:
                    todo.append(child)
        return found


class Spellings:
    """Distances of one word to all words of a list at once: the same bits as ``edits``, one lane for each word of the list. Longer words than
    a lane has bits are measured one by one."""

    def __init__(self, words: list[str]):
        self.words = words
        lengths = [len(w) for w in words]
        self.long = [i for i, n in enumerate(lengths) if n > 63]
        self.bits: dict[str, np.ndarray] = {}
        for i, w in enumerate(words):
            if lengths[i] <= 63:
                for p, ch in enumerate(w):
                    if ch not in self.bits:
                        self.bits[ch] = np.zeros(len(words), np.uint64)
                    self.bits[ch][i] |= np.uint64(1 << p)
        self.length = np.array(lengths, np.int32)
        self.full = np.array([(1 << min(n, 63)) - 1 for n in lengths], np.uint64)
        self.last = np.array([1 << max(min(n, 63) - 1, 0) for n in lengths], np.uint64)
        self.none = np.zeros(len(words), np.uint64)
        self.held: dict[str, np.ndarray] = {}

    def row(self, word: str) -> np.ndarray:
        """Levenshtein distances of ``word`` to each word of the list."""
        got = self.held.get(word)
        if got is not None:
            return got
        if len(self.held) * len(self.words) > 20_000_000:
            self.held.clear()
        one = np.uint64(1)
        up, down, score = self.full.copy(), self.none.copy(), self.length.copy()
        for ch in word:
            eq = self.bits.get(ch, self.none)
            x = eq | down
            eq = eq | (((eq & up) + up) ^ up)
            more, less = down | (~(eq | up) & self.full), up & eq
            score += (more & self.last) != 0
            score -= (less & self.last) != 0
            more = (more << one) | one
            less = less << one
            up = (less | ~(x | more)) & self.full
            down = more & x & self.full
        for i in self.long:
            score[i] = edits(word, self.words[i])
        self.held[word] = score
        return score


def pairing(cost: np.ndarray) -> np.ndarray:
    """The least sum when the n rows of each n x n matrix are paired with its columns. Matrices of more than ten rows are solved one by one."""
    n = cost.shape[1]
    if n == 1:
        return cost[:, 0, 0]
    if n > 10:
        return np.array([_hungarian(c) for c in cost.tolist()], np.int32)
    state = {0: np.zeros(len(cost), np.int32)}
    for i in range(n):
        after: dict[int, np.ndarray] = {}
        for mask, c in state.items():
            for j in range(n):
                if not mask >> j & 1:
                    v, key = c + cost[:, i, j], mask | 1 << j
                    after[key] = np.minimum(after[key], v) if key in after else v
        state = after
    return state[(1 << n) - 1]


def _hungarian(cost: list[list[int]]) -> int:
    """Least pairing by augmenting paths with potentials."""
    n = len(cost)
    u, v, owner = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, way, used = [10**9] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while True:
            used[j0] = True
            row, step, j1 = owner[j0], 10**9, 0
            for j in range(1, n + 1):
                if not used[j]:
                    c = cost[row - 1][j - 1] - u[row] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < step:
                        step, j1 = least[j], j
            for j in range(n + 1):
                if used[j]:
                    u[owner[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    return -v[0]


class EntryTree:
    """BK-tree over entries of n words each (rows of word numbers) under the order-free edit metric: the least sum of Levenshtein distances when the words of
    two entries are paired. It is built and searched level by level, for many queries at once."""

    def __init__(self, entries: np.ndarray, spellings: Spellings):
        self.entries = entries
        count = len(entries)
        here = np.arange(1, count, dtype=np.int64)
        parent = np.zeros(count - 1, np.int64)
        keys, nodes = [], []
        while len(here):
            d = np.empty(len(here), np.int64)
            order = np.argsort(parent, kind="stable")
            for part in np.array_split(order, max(1, len(order) // 20_000)):
                words, at = np.unique(entries[parent[part]], return_inverse=True)
                rows = np.stack([spellings.row(spellings.words[w]) for w in words])
                d[part] = pairing(rows[at.reshape(-1, entries.shape[1])[:, :, None], entries[here[part]][:, None, :]])
            edge = (parent << 16) | np.minimum(d, 65_535)
            first, where, back = np.unique(edge, return_index=True, return_inverse=True)
            keys.append(first)
            nodes.append(here[where])
            left = np.ones(len(here), bool)
            left[where] = False
            parent = here[where][back][left]
            here = here[left]
        order = np.argsort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        self.edges = np.concatenate(keys)[order] if keys else order
        self.nodes = np.concatenate(nodes)[order] if keys else order

    def within(self, low: np.ndarray, high: np.ndarray, queries: np.ndarray, radius: np.ndarray) -> Iterator[tuple[int, int]]:
        """(query, entry) for every entry within the query's radius. A query is n numbers of rows of ``low`` and ``high``: the least and the greatest distance of what
        a token may stand for to each word. With d the distance of a query to a node, entries below a child at edge e are at least |d - e| away."""
        unsure = (low != high).any(axis=1)
        size = max(16, 1_500_000 // (len(self.entries) + 1))
        for start in range(0, len(queries), size):
            query = np.arange(start, min(len(queries), start + size))
            node = np.zeros(len(query), np.int64)
            while len(query):
                token, words, r = queries[query][:, :, None], self.entries[node][:, None, :], radius[query]
                near = pairing(low[token, words])
                far = near.copy()
                wide = unsure[queries[query]].any(axis=1)
                if wide.any():
                    far[wide] = pairing(high[token[wide], words[wide]])
                hit = near <= r
                yield from zip(query[hit].tolist(), node[hit].tolist())
                a = np.searchsorted(self.edges, (node << 16) | np.clip(near - r, 0, 65_535))
                z = np.searchsorted(self.edges, (node << 16) | np.clip(far + r, 0, 65_535), side="right")
                many = np.maximum(z - a, 0)
                query = np.repeat(query, many)
                node = self.nodes[np.repeat(a - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]


class StringTree:
    """BK-tree over strings under Levenshtein distance, built and searched level by level for many strings at once: each (query, node) pair is a lane
    of the same bits as ``edits``. Strings longer than a lane has bits are kept apart and measured one by one."""

    def __init__(self, strings: list[str]):
        self.strings = [s for s in strings if len(s) <= 63]
        self.long = [s for s in strings if len(s) > 63]
        self.code = {ch: i + 1 for i, ch in enumerate(sorted(set("".join(self.strings))))}
        count = len(self.strings)
        self.length = np.array([len(s) for s in self.strings], np.int64)
        self.bits = np.zeros((count, len(self.code) + 1), np.uint64)
        for i, s in enumerate(self.strings):
            for p, ch in enumerate(s):
                self.bits[i, self.code[ch]] |= np.uint64(1 << p)
        typed, sizes = self._codes(self.strings)
        here = np.arange(1, count, dtype=np.int64)
        parent = np.zeros(max(count - 1, 0), np.int64)
        edges, nodes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(here):
            edge = (parent << 16) | self._far(typed, sizes, here, parent)
            first, where, back = np.unique(edge, return_index=True, return_inverse=True)
            edges.append(first)
            nodes.append(here[where])
            left = np.ones(len(here), bool)
            left[where] = False
            parent, here = here[where][back][left], here[left]
        order = np.argsort(np.concatenate(edges))
        self.edges, self.nodes = np.concatenate(edges)[order], np.concatenate(nodes)[order]

    def _codes(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(s) for s in strings], np.int64)
        out = np.zeros((len(strings), int(sizes.max(initial=0))), np.int16)
        for i, s in enumerate(strings):
            out[i, : len(s)] = [self.code.get(ch, 0) for ch in s]
        return out, sizes

    def _far(self, typed: np.ndarray, sizes: np.ndarray, query: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Distances of pairs (query, node)."""
        one = np.uint64(1)
        n = self.length[node]
        full = (one << n.astype(np.uint64)) - one
        last = one << np.maximum(n - 1, 0).astype(np.uint64)
        up, down, score = full.copy(), np.zeros(len(node), np.uint64), n.copy()
        result = score.copy()
        size = sizes[query]
        for step in range(int(size.max(initial=0))):
            eq = self.bits[node, typed[query, step]]
            x = eq | down
            eq = eq | (((eq & up) + up) ^ up)
            more, less = down | (~(eq | up) & full), up & eq
            score = score + ((more & last) != 0) - ((less & last) != 0)
            more, less = (more << one) | one, less << one
            up, down = (less | ~(x | more)) & full, more & x & full
            result = np.where(step < size, score, result)
        return result

    def within(self, queries: list[str], radius: int) -> Iterator[tuple[str, str]]:
        """(query, string) for every string within the radius."""
        for q in queries:
            for s in self.long:
                if abs(len(q) - len(s)) <= radius and edits(q, s) <= radius:
                    yield q, s
        queries = [q for q in queries if len(q) <= 63 + radius]
        for start in range(0, len(queries) if self.strings else 0, 256):
            asked = queries[start : start + 256]
            typed, sizes = self._codes(asked)
            query, node = np.arange(len(asked)), np.zeros(len(asked), np.int64)
            while len(query):
                d = self._far(typed, sizes, query, node)
                for i, j in zip(query[d <= radius].tolist(), node[d <= radius].tolist()):
                    yield asked[i], self.strings[j]
                a = np.searchsorted(self.edges, (node << 16) | np.maximum(d - radius, 0))
                many = np.searchsorted(self.edges, (node << 16) | (d + radius), side="right") - a
                query = np.repeat(query, many)
                node = self.nodes[np.repeat(a - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
