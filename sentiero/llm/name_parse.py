"""Reading an organisation's name into common words, proper tokens, given name and ordinal number.

Which words are common (kinds of activity and the like) is learnt from the corpus, not listed here.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from .nicknames import NICKNAMES
from .textnorm import NearIndex, fold, shared_index
from .vocabulary import Vocabulary

# Words for one thing that share no spelling; a parameter of the reader. Bodies of a place are named by it.
SYNONYMS = {"municipio": "comune", "amministrazione": "comune", "acconciature": "parrucchiera", "parrucchiere": "parrucchiera", "acconciatore": "parrucchiera"}
# Words that tell nothing.
STOP_WORDS = frozenset("di e ed del dello della dei degli delle dell al alla la il lo le gli i de da d l c co".split())
_LEGAL = re.compile(r"(?:\bsoc(?:ieta)?\b\.? ?coop(?:erativa)?\b\.?(?: ?soc(?:iale)?\b\.?)?(?=\s*(?:$|[,(@\-\"]|di\b))|&? ?c\.? s\.?n\.?c\b\.?|\bs\.? ?r\.? ?l\.?s?\b\.?|\bs\.? ?n\.? ?c\b\.?|\bs\.? ?c\.? ?s\b\.?|\bo\.? ?d\.? ?v\b\.?|\ba\.? ?p\.? ?s\b\.?|\ba\.? ?s\.? ?d\b\.?|\bs\.? ?p\.? ?a\b\.?|\bs\.? ?a\.? ?s\b\.?|\bs\.? ?s\.? ?d\b\.?|\bonlus\b|& ?c\.?(?=\s|$))")
_TOKEN = re.compile(r"[^\W_]+(?:\.[^\W\d_]{1,3}(?![^\W\d_]))?\.?|[(),@\-:/]")
_ELISION = re.compile(r"\b([a-z]{1,6})'(?=[a-z])")
_ELIDED = NearIndex(("dell", "nell", "sull", "dall"))
_ARTICLE = re.compile(r"(?:del{1,2}|all|nell|sull|dall)(?=[aeiou])")
_ORDINAL_SIGN = re.compile(r"\bn(?:\.|°|r\.|um\.| )? ?(\d{1,3}|i{1,3}|iv|v)\b|\bnr?\.? ?(\d{1,3})\b")
_STRAY, _ZERO, _JOINED = re.compile(r"(?<=[a-z])'(?![a-z])"), re.compile(r"(?<=[a-z])0(?=[a-z]|\b)"), re.compile(r"(?<=[a-z]{3})-(?=[a-z]{3})")
_ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8", "ix": "9"}
#: Letters from which on an undotted beginning of a common word stands for it.
BEGINNING = 5


class Name(NamedTuple):
    activity: str
    word: str
    given: tuple[str, ...]
    number: str


class NameReader:
    """Parses organisation names.

    ``vocabulary`` tells which words are common; ``places`` are locality names, which a name may carry besides, ``towns``
    the municipalities they belong to; ``nicknames`` and ``synonyms`` are tables by full form and by word.
    """

    def __init__(self, vocabulary: Vocabulary | None = None, places: frozenset[str] = frozenset(), towns: Sequence[str] = (), nicknames: Mapping[str, tuple[str, ...]] = NICKNAMES, synonyms: Mapping[str, str] = SYNONYMS) -> None:
        self.places, self.towns = places, frozenset(towns)
        self.index = shared_index(self.places | self.towns)
        self.synonyms = dict(synonyms)
        self.given_of: dict[str, tuple[str, ...]] = {}
        for full, shorts in nicknames.items():
            for form in (full, *shorts):
                self.given_of[form] = (*self.given_of.get(form, ()), full)
        self.near_full, self.near_given = NearIndex(nicknames), NearIndex([n for n in self.given_of if len(n) >= 4], 1)
        counts, self.together = vocabulary or Vocabulary({}, {})
        counts = {w: n for w, n in counts.items() if w not in self.given_of and w not in places and w not in self.towns and w not in STOP_WORDS}
        counts |= {w: max(counts.get(w, 0), 1) for w in {*synonyms, *synonyms.values()}}
        # A common word eight times rarer than one it resembles is a frequent misspelling of it.
        near = NearIndex([w for w in counts if len(w) >= 5])
        near_to = lambda w: [v for d, v in near.find(w, 1 if len(w) < 7 else 2) if d and counts[v] >= 8 * counts[w]]
        counts = {w: n for w, n in counts.items() if w in self.synonyms or len(w) < 5 or not near_to(w)}
        # One that only begins a commoner one is a short form, and two run together are two.
        starts: dict[str, int] = {}
        for w, n in counts.items():
            for k in range(BEGINNING, len(w)):
                starts[w[:k]] = max(starts.get(w[:k], 0), n)
        self.joined = {v + w: (v, w) for v, w in self.together if v in counts and w in counts}
        self.counts = {w: n for w, n in counts.items() if w in self.synonyms or w not in self.joined and starts.get(w, 0) < 2 * n}
        # Values that hold a word without its usual companion.
        most: dict[str, int] = {}
        for (v, _), n in self.together.items():
            most[v] = max(most.get(v, 0), n)
        self.alone = {w: n - most.get(w, 0) for w, n in self.counts.items()}
        self.near_common = NearIndex([w for w in self.counts if len(w) >= 4])
        self.begins: dict[str, list[str]] = {}
        for w in sorted(self.counts, key=lambda w: (-self.counts[w], w)):
            for n in range(1, len(w)):
                self.begins.setdefault(w[:n], []).append(w)
        self.common: dict[str, tuple[str, ...]] = {}
        self.short: dict[str, list[str]] = {}
        self.given: dict[str, tuple[str, ...]] = {}
        self.near: dict[str, bool] = {}

    def _common(self, token: str) -> tuple[str, ...]:
        """The common words an undotted token stands for: itself, two run together, a long beginning or a misspelling."""
        if token not in self.common:
            found: tuple[str, ...] = ()
            if token in self.counts:
                found = (token,)
            elif token in self.joined:
                found = self.joined[token]
            elif (rest := _ARTICLE.sub("", token, count=1) if _ARTICLE.match(token) else "") in self.counts:
                found = (rest,)
            elif token not in self.given_of:
                if len(token) >= BEGINNING and token in self.begins:
                    found = (self.begins[token][0],)
                elif len(token) >= 4:
                    close = [(d, -self.counts[w], w) for d, w in self.near_common.find(token, 1 if len(token) < 6 else 2) if d <= (1 if len(w) < 6 else 2)]
                    if close:
                        found = (min(close)[2],)
                    elif len(token) >= 6 and (likely := self.near_common.likely(token, 0.92)):
                        found = (likely,)
            self.common[token] = found
        return self.common[token]

    def _short_for(self, token: str) -> list[str]:
        """Common words a dotted token may stand for, most frequent first: beginnings, or first and last letters, or letters left out."""
        if token not in self.short:
            bare = token.rstrip(".")
            if "." in bare:
                head, _, tail = bare.rpartition(".")
                found = [w for w in self.begins.get(head.replace(".", ""), []) if w.endswith(tail) and len(w) >= len(bare)]
            else:
                found = [*([bare] if bare in self.counts else []), *self.begins.get(bare, [])]
                if not found and len(bare) >= 2:
                    found = [w for w in self.begins.get(bare[0], []) if len(w) > len(bare) and _left_out(bare, w)]
            self.short[token] = found
        return self.short[token]

    def _given(self, token: str) -> tuple[str, ...]:
        if token not in self.given:
            found = self.given_of.get(token, ())
            if not found and len(token) >= 4:
                close = self.near_full.find(token) or [(d, g) for d, n in self.near_given.find(token, 1) for g in self.given_of[n]]
                found = tuple(sorted({g for d, g in close if d == close[0][0]}))
            self.given[token] = found
        return self.given[token]

    def _place(self, token: str) -> bool:
        if token not in self.near:
            self.near[token] = token in self.places or token in self.towns or len(token) >= 6 and bool(self.index.find(token))
        return self.near[token]

    def _best(self, options: Sequence[str], beside: set[str]) -> tuple[int, str]:
        """The option most often seen with the words beside it, and how often."""
        seen = lambda w: sum(self.together.get((w, v), 0) for v in beside)
        best = max(options, key=lambda w: (seen(w), self.alone.get(w, 0), self.counts.get(w, 0)))
        return seen(best), best

    def read(self, text: str | None) -> Name | None:
        """The parts of a name, or None where there is none: ``activity`` the sorted common words, ``word`` the sorted proper
        tokens, ``given`` the given names it may mean, ``number`` the ordinal."""
        if not text:
            return None
        s = " ".join(fold(text).replace('"', " ").split())
        if "0" in s:
            s = _ZERO.sub("o", s)
        s = _LEGAL.sub(" ", s)
        if "'" in s:
            s = _ELISION.sub(_unjoined, _STRAY.sub("", s)).replace("'", "")
        if "-" in s:
            s = _JOINED.sub(" ", s)
        number = ""
        m = _ORDINAL_SIGN.search(s)
        if m:
            number = _ROMAN.get(m[1] or "", m[1] or m[2])
            s = s[: m.start()] + " " + s[m.end() :]
        common: set[str] = set()
        shorts: list[tuple[str, list[str]]] = []
        initials: list[tuple[str, str]] = []
        words: list[str] = []
        given: tuple[str, ...] = ()
        after_mark, fallback = False, ""
        tokens = _TOKEN.findall(s)
        for i, t in enumerate(tokens):
            if t in "(),@-:/":
                after_mark = True
                continue
            dotted, bare = "." in t, t.rstrip(".")
            if not bare:
                continue
            if len(bare) == 1 and bare.isalpha():
                following = tokens[i + 1].rstrip(".") if i + 1 < len(tokens) else ""
                if dotted or bare not in STOP_WORDS and bare not in _ROMAN:
                    initials.append((bare, following))
                    continue
            if bare in STOP_WORDS and not dotted and bare not in _ROMAN:
                after_mark = after_mark or bare == "di"
                continue
            if not dotted and (bare.isdigit() or bare in _ROMAN):
                number = number or _ROMAN.get(bare, bare.lstrip("0") or "0")
                continue
            if bare in self.given_of and not given:
                given = self.given_of[bare]
                continue
            if dotted and len(bare) > 1:
                # A short form of no common word stands for one that is only ever written short.
                shorts.append((t, self._short_for(t) or [bare.replace(".", "")]))
                continue
            hit = self._common(bare) if "." not in bare else ()
            if hit:
                common.update(hit)
                continue
            g = self._given(bare)
            if g and not given:
                given = g
                continue
            if bare in self.towns or (after_mark and self._place(bare)) or (words and bare in self.places):
                fallback = fallback or bare
                after_mark = False
                continue
            words.append(bare.replace(".", ""))
            after_mark = False
        # Short forms are read by the common words they stand with.
        for _, options in sorted(shorts, key=lambda x: len(x[1])):
            common.add(self._best(options, common)[1])
        left = ""
        for letter, following in initials:
            options = self.begins.get(letter, [])
            beside = {*self._common(following), *(self._short_for(following + ".")[:1] if following and not self._common(following) else ())} & self.counts.keys()
            seen, best = self._best(options, beside or common) if options else (0, "")
            if seen and beside and seen >= 0.2 * min(self.counts[v] for v in beside):
                common.add(best)
            elif options and not beside and not words and not common:
                left = left or letter
            else:
                left = left or letter
        activity = " ".join(sorted({self.synonyms.get(w, w) for w in common}))
        if not words and fallback:
            words = [fallback]
        if not words and given:
            words, given = [given[0]], ()
        if not words:
            return Name(activity, "", given, number) if activity else None
        if not given and left:
            given = (left,)
        return Name(activity, " ".join(sorted(set(words))), given, number)


def _unjoined(m: re.Match) -> str:
    """Nothing for an elided article, also a misspelt one; else what stands before the apostrophe."""
    return " " if m[1] in ("d", "l", "un", "all", "del") or len(m[1]) >= 4 and _ELIDED.find(m[1]) else m[1]


def _left_out(short: str, word: str) -> bool:
    """The letters of ``short`` stand in ``word`` in order, the first one first, and no vowel among the rest."""
    at = iter(word)
    return short[0] == word[0] and not set(short[1:]) & set("aeiou") and all(c in at for c in short)
