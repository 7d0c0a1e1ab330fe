"""Spelling primitives shared by the record-linkage operators (pure Python, used inside pandas UDFs)."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

_APOSTROPHES = str.maketrans({"’": "'", "‘": "'", "`": "'", "´": "'", "º": "°", "–": "-", "—": "-", " ": " ", "“": '"', "”": '"'})
_KEY_ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm")


def _adjacent_keys() -> frozenset[tuple[str, str]]:
    at = {c: (r, i + 0.5 * r) for r, row in enumerate(_KEY_ROWS) for i, c in enumerate(row)}
    return frozenset((a, b) for a, (r, x) in at.items() for b, (s, y) in at.items() if a != b and abs(r - s) <= 1 and abs(x - y) <= 1.0)


# Letters taken for one another by eye or ear.
_ALIKE = "o0 i1 l1 ae ei ou bp dt mn sz cg fv"
ADJACENT = _adjacent_keys() | {(x, y) for pair in _ALIKE.split() for x, y in (pair, pair[::-1])}


def fold(text: str) -> str:
    """Lower case, no accents, typographic quotes and dashes unified, no-break blanks as blanks."""
    text = text.lower()
    if text.isascii():
        return text.replace("`", "'")
    text = unicodedata.normalize("NFKD", text.translate(_APOSTROPHES))
    return "".join(c for c in text if not unicodedata.combining(c))


def _few_typos(a: str, b: str) -> int:
    """``typo_distance`` to 2 of two texts that begin and end with different letters: 3 for more.

    Either one edit is all there is, or one stands at the beginning, one at the end, and what lies between is the same.
    """
    m, n = len(a), len(b)
    if m == n == 1:
        return 1 if (a, b) in ADJACENT else 2
    if m == n == 2 and a[0] == b[1] and a[1] == b[0]:
        return 1
    if m - n == 2:
        return 2 if a[1:-1] == b else 3
    if n - m == 2:
        return 2 if b[1:-1] == a else 3
    # How many letters a letter mistaken or a swap takes from either side.
    first = [*([1] if (a[0], b[0]) in ADJACENT else ()), *([2] if a[1:2] == b[0] and b[1:2] == a[0] else ())]
    last = [*([1] if (a[-1], b[-1]) in ADJACENT else ()), *([2] if a[-2:-1] == b[-1] and b[-2:-1] == a[-1] else ())]
    if m > n:
        found = any(a[i:-1] == b[i:] for i in first) or any(a[1 : m - i] == b[: n - i] for i in last if i <= n)
    elif n > m:
        found = any(b[i:-1] == a[i:] for i in first) or any(b[1 : n - i] == a[: m - i] for i in last if i <= m)
    else:
        found = a[1:] == b[:-1] or a[:-1] == b[1:] or any(i + j <= m and a[i : m - j] == b[i : n - j] for i in first for j in last)
    return 2 if found else 3


def typo_distance(a: str, b: str, limit: int = 2) -> int:
    """Edits that turn ``a`` into ``b``, or ``limit + 1`` when there are more.

    Insertions, deletions, swaps of neighbours, hits of a neighbouring key and letters that look or sound alike cost 1, other
    substitutions 2.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    # What both begin and end with costs nothing.
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    j = 0
    while j < n - i and a[-1 - j] == b[-1 - j]:
        j += 1
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if not a or not b:
        return min(len(a) + len(b), limit + 1)
    if limit <= 2:
        return min(_few_typos(a, b) if limit == 2 or len(a) == len(b) <= 2 else 3, limit + 1)
    # Only cells within ``limit`` of the diagonal can stay within the limit, so long texts cost no more than their length.
    far = limit + 1
    before: dict[int, int] = {}
    row = {j: j for j in range(min(len(b), limit) + 1)}
    for i, x in enumerate(a, 1):
        now = {0: i} if i <= limit else {}
        for j in range(max(1, i - limit), min(len(b), i + limit) + 1):
            y = b[j - 1]
            if x == y:
                cost = row.get(j - 1, far)
            else:
                cost = row.get(j - 1, far) + (1 if (x, y) in ADJACENT else 2)
                cost = min(cost, row.get(j, far) + 1, now.get(j - 1, far) + 1)
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    cost = min(cost, before.get(j - 2, far) + 1)
            now[j] = cost
        if min(now.values()) > limit:
            return far
        before, row = row, now
    return min(row.get(len(b), far), far)


def jaro_winkler(a: str, b: str) -> float:
    """Jaro-Winkler similarity (prefix weight 0.1, at most four letters)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, left = [False] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, t in zip(b, taken, strict=True) if t]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


@lru_cache(maxsize=256)
def deletions(word: str, depth: int) -> frozenset[str]:
    """The word and all strings made of it by taking away up to ``depth`` letters, down to three."""
    n = len(word)
    found = {word}
    if depth >= 1 and n > 3:
        found.update([word[:i] + word[i + 1 :] for i in range(n)])
    if depth >= 2 and n > 4:
        found.update([word[:i] + word[i + 1 : j] + word[j + 1 :] for i in range(n - 1) for j in range(i + 1, n)])
    return frozenset(found)


def _letters(word: str) -> int:
    """The set of a word's characters as bits (characters that share a bit only make the set smaller)."""
    mask = 0
    for c in word:
        mask |= 1 << (ord(c) & 63)
    return mask


def _shortened(word: str, depth: int) -> set[str]:
    """The word and all strings made of it by taking away up to ``depth`` (at most two) letters."""
    found = {word}
    if depth >= 1:
        found.update([word[:i] + word[i + 1 :] for i in range(len(word))])
    if depth >= 2:
        found.update([word[:i] + word[i + 1 : j] + word[j + 1 :] for i in range(len(word) - 1) for j in range(i + 1, len(word))])
    return found


class NearIndex:
    """Finds the words of a fixed list that a token may stand for, within a few typing errors.

    Of a short list and of short words those are compared whose length is similar and whose letters differ by no more than
    the errors allow. Of a long list words are found by what is left when letters are taken away: each error is gone when
    one letter is taken from either side. That takes about sixty numbers a word and no longer for a longer list.
    """

    #: Words up to which letters are compared one by one, which is faster for few, and letters up to which they always are.
    SHORT_LIST, SHORT_WORD = 400, 5

    def __init__(self, words, depth: int = 2) -> None:
        self.depth, listed = depth, list(dict.fromkeys(words))
        self.heads: dict[str, list[str]] = {}
        self.sizes: dict[int, list[tuple[int, str]]] = {}
        self.long: list[str] = [w for w in listed if len(w) > self.SHORT_WORD] if len(listed) > self.SHORT_LIST else []
        self.left: tuple[np.ndarray, np.ndarray] | None = None
        for w in listed:
            if not self.long or len(w) <= self.SHORT_WORD:
                self.sizes.setdefault(len(w), []).append((_letters(w), w))
            self.heads.setdefault(w[:2], []).append(w)
        self.longest = max(map(len, listed), default=0)

    def _left(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of what is left of the long list's words, in order, and the word of each."""
        if self.left is None:
            parts = [np.fromiter(map(hash, _shortened(w, self.depth)), np.int64) for w in self.long]
            hashes, of = np.concatenate(parts), np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
            order = np.argsort(hashes)
            self.left = hashes[order], of[order]
        return self.left

    def find(self, token: str, limit: int = 2) -> list[tuple[int, str]]:
        """(errors, word) of the words at most ``limit`` typing errors from ``token``, nearest first."""
        limit, n = min(limit, self.depth), len(token)
        if n > self.longest + limit:
            return []
        mask, sizes, near = _letters(token), self.sizes, []
        for k in range(n - limit, n + limit + 1):
            if k in sizes:
                # An edit changes the set by two letters at most, one that changes the length by one.
                most = 2 * limit - abs(k - n)
                near += [w for m, w in sizes[k] if (m ^ mask).bit_count() <= most]
        if self.long and n + limit > self.SHORT_WORD:
            hashes, of = self._left()
            wanted = np.fromiter(map(hash, _shortened(token, limit)), np.int64)
            ends = zip(np.searchsorted(hashes, wanted, "left").tolist(), np.searchsorted(hashes, wanted, "right").tolist(), strict=True)
            near += [self.long[i] for i in {i for a, b in ends if a < b for i in of[a:b].tolist()}]
        return sorted((d, w) for w in near if (d := typo_distance(token, w, limit)) <= limit)

    def likely(self, token: str, least: float) -> str:
        """The most similar word with the same first two letters, by Jaro-Winkler; "" under ``least``."""
        best = max(((jaro_winkler(token, w), w) for w in self.heads.get(token[:2], ())), default=(0.0, ""))
        return best[1] if best[0] >= least else ""


@lru_cache(maxsize=8)
def shared_index(words: frozenset[str], depth: int = 2) -> NearIndex:
    """The index of a list of words, built once in a process."""
    return NearIndex(sorted(words), depth)
