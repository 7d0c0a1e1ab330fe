"""Reading an Italian postal address into street kind, street words, civic number, suffix, locality, given name and numeral."""

from __future__ import annotations

import re
from typing import NamedTuple

from .nicknames import NICKNAMES
from .textnorm import NearIndex, fold, shared_index, typo_distance
from .vocabulary import Gazetteer

# Written forms of street kinds, titles, number words and notes.
KINDS = {
    "via": ("via", "v"),
    "viale": ("viale", "vle", "v.le"),
    "vicolo": ("vicolo", "vic", "vlo", "v.lo", "vico"),
    "piazza": ("piazza", "pza", "pzza", "p.za", "p.zza", "piaz", "p"),
    "piazzale": ("piazzale", "ple", "p.le", "pzle", "p.zle", "piazz.le"),
    "piazzetta": ("piazzetta", "p.tta"),
    "largo": ("largo", "lgo", "l.go"),
    "corso": ("corso", "cso", "c.so"),
    "strada": ("strada", "str", "s.da"),
    "localita": ("localita", "loc", "localita'", "loc.ta"),
    "salita": ("salita", "sal"),
    "contrada": ("contrada", "c.da"),
    "frazione street": (),
}
TITLES = frozenset("don d dott dr dottor maestro m.tro m.o mo mtro santa santo san sant s s.ta s.to sta".split())
TITLE_OF = {"don": "don", "d": "d", "dott": "dott", "dr": "dott", "dottor": "dott", "maestro": "maestro", "m.tro": "maestro", "m.o": "maestro", "mo": "maestro", "mtro": "maestro", "santa": "santa", "santo": "santa", "san": "santa", "sant": "santa", "s": "santa", "s.ta": "santa", "s.to": "santa", "sta": "santa"}
NUMBER_WORDS = {"due": "2", "tre": "3", "quattro": "4", "cinque": "5", "sei": "6", "sette": "7", "otto": "8", "nove": "9", "dieci": "10", "undici": "11", "dodici": "12", "venti": "20", "ventiquattro": "24", "venticinque": "25"}
_NOTES = re.compile(r"\(?\b(?:ingresso (?:dal|da|sul) \w+|c/o .*|presso .*|lato \w+|piano (?:terra|rialzato|primo|secondo)|(?:primo|secondo|terzo) piano|interno \w+|int\.? ?\w{1,3}|scala \w|citofono .*)\)?$|\(?\b\d{1,2} ?(?:°|o)? piano\)?|\((?:ingresso|lato)[^)]*\)|\bingresso dal \w+\b|\bpiano terra\b")
_ROMAN = re.compile(r"x{1,3}(?:i[vx]|v?i{0,3})|i[vx]|vi{1,3}|i{2,3}")
_ROMAN_VALUE = {"i": 1, "v": 5, "x": 10}
_KIND_OF = {form.replace(".", ""): kind for kind, forms in KINDS.items() for form in forms}
_ABBREVIATED = re.compile(
    r"(?P<piazzale>\bpiaz{1,2}\. ?le\b\.?|\bp\.? ?z?le\b\.?)|(?P<piazza>\bp\. ?z?za\b\.?|\bpiaz\.)|(?P<viale>\bv\. ?le\b\.?|\bvle\b\.?)|(?P<vicolo>\bv\. ?lo\b\.?|\bvlo\b\.?)"
    r"|(?P<largo>\bl\. ?go\b\.?|\blgo\b\.?)|(?P<corso>\bc\. ?so\b\.?|\bcso\b\.?)|(?P<maestro>\bm\. ?(?:tro|o)\b\.?)|(?P<santa>\bs\. ?t[aoe]\b\.?)|(?P<strada>\bs\. ?da\b\.?)"
    r"|(?P<piazzetta>\bp\. ?tta\b\.?)|(?P<contrada>\bc\. ?da\b\.?)"
)
_NOTE_HINT = re.compile(r"ingr|c/o|press|lato|piano|intern|int|scala|citof")
_BLANKS, _BREAKS, _STRAY = re.compile(r"\s+"), re.compile(r"\s*[\n\r]+\s*"), re.compile(r"(?<=[a-z])'(?![a-z])")
_PROVINCE, _HAMLET = re.compile(r"\(\s*[a-z]{2}\s*\)"), re.compile(r"\b(?:fraz|frazione)\b\.? ?([a-z']+)")
_PROVINCE_LAST = re.compile(r"(?<=[a-z]{3}) (?!vi$)[a-z]{2}$")
_CAP = re.compile(r"\b(\d{5,7})\b\s*([a-z']{3,})?")
_NUMBER = re.compile(r"(?<![\w°.])(?:(?:n|nr|num|civico|civ|numero)\b\.? ?°? ?|n° ?)?(\d{1,4})(?!\d|°)(?:\s*[/-]?\s*(bis|ter|quater|[a-hA-H](?![\w.'])))?(?![\w])")
_TOKEN = re.compile(r"\d+|[a-z0-9']+\.?|[,\-()/;:]")


#: Stands for a place that a misspelling leaves open.
SEVERAL = "?"


class Address(NamedTuple):
    kind: str
    word: str
    number: str
    suffix: str
    locality: str
    given: str
    numeral: str
    bare: str


def _numeral(token: str) -> str:
    """A number in a street's name, as digits: "quattro", "4", "iv"."""
    if token in NUMBER_WORDS:
        return NUMBER_WORDS[token]
    if token.isdigit():
        return token.lstrip("0")
    if _ROMAN.fullmatch(token):
        at = [_ROMAN_VALUE[c] for c in token]
        return str(sum(-v if i + 1 < len(at) and v < at[i + 1] else v for i, v in enumerate(at)))
    return ""


def _kind_of(token: str) -> str:
    return _KIND_OF.get(token.rstrip("."), "")


class AddressReader:
    """Parses addresses; ``places`` are the place names and municipalities learnt from the addresses, ``given`` given names."""

    def __init__(self, places: Gazetteer | None = None, given: tuple[str, ...] = tuple(NICKNAMES)) -> None:
        self.by_code, self.towns = places or Gazetteer({}, frozenset())
        self.places = frozenset(self.by_code.values())
        self.given = NearIndex(given, 1)
        self.near: dict[str, str] = {}
        self.named: dict[str, str] = {}
        self.index, self.town_index = shared_index(self.places | self.towns), shared_index(self.towns)
        self.sharing: dict[str, list[str]] = {}
        for key, place in self.by_code.items():
            if " " in key:
                self.sharing.setdefault(key.partition(" ")[0], []).append(place)

    def given_name(self, token: str) -> str:
        """The given name a token is, or is one typing error from; "" for other tokens."""
        if token not in self.named:
            found = self.given.find(token, 1) if len(token) >= 4 else []
            self.named[token] = found[0][1] if found else ""
        return self.named[token]

    def coded_place(self, code: str, word: str) -> str:
        """The place of a postal code; of a code that several share, the one the word after it names, "" for none."""
        if code in self.by_code:
            return self.by_code[code]
        shared = self.sharing.get(code)
        if not shared or word in shared:
            return word
        near = min(((d, p) for p in shared if (d := typo_distance(word, p)) <= 2), default=None)
        named = near[1] if near else self.place(word, False)
        return "" if named in self.towns else named

    def place(self, token: str, fuzzy: bool) -> str:
        """The place or town a token is or, if ``fuzzy``, is nearest to; ``SEVERAL`` where several are as near."""
        if token in self.places or token in self.towns:
            return token
        if not fuzzy or len(token) < 6:
            return ""
        if token not in self.near:
            found = self.index.find(token)
            tied = len(found) > 1 and found[0][0] == found[1][0]
            self.near[token] = SEVERAL if tied else found[0][1] if found else ""
        return self.near[token]

    def near_place(self, token: str, known: str) -> str:
        """``place`` of a token that may be misspelt; where the locality is known, only that one or a town."""
        if not known or len(token) < 6:
            return self.place(token, True)
        if typo_distance(token, known) <= 2:
            return known
        found = self.town_index.find(token)
        return found[0][1] if found else ""

    def read(self, text: str | None) -> Address | None:
        """The parts of an address, or None where it names no street."""
        if not text:
            return None
        # Each pattern is only searched where a plain test lets it be there.
        s = fold(text)
        if not s.isprintable():
            s = _BREAKS.sub(", ", s)
        s = s.strip(" \t\"'")
        if "  " in s or not s.isprintable():
            s = _BLANKS.sub(" ", s)
        if "'" in s:
            s = _STRAY.sub("", s)
        if _NOTE_HINT.search(s):
            for _ in range(2):
                s = _NOTES.sub(" ", s).strip(" ,-;")
        s = s.strip(" ,-;")
        if "." in s or "vle" in s or "vlo" in s or "lgo" in s or "cso" in s:
            s = _ABBREVIATED.sub(lambda k: k.lastgroup + " ", s)
        locality = ""
        m = _CAP.search(s)
        if m:
            locality = self.coded_place(m[1], m[2] or "")
            tail = m[2] if m[2] and (self.place(m[2], True) or m[2] == locality) else ""
            s = (s[: m.start()] + " , " + s[m.end(1) + (len(m[0]) - len(m[1]) if tail else 0) :]).strip()
        s = (_PROVINCE.sub(" ", s) if "(" in s else s).strip(" ,-")
        if s[-3:-2] == " ":
            s = _PROVINCE_LAST.sub("", s)
        m = _HAMLET.search(s) if "fraz" in s else None
        if m:
            named = self.place(m[1], True)
            locality = locality or (m[1] if named == SEVERAL else named or m[1])
            s = s[: m.start()] + " , " + s[m.end() :]
        # Civic number: not one that belongs to the street's name (a number word before the street word).
        found = list(_NUMBER.finditer(s))
        civic = None
        if len(found) > 1:
            def inner(k: re.Match) -> bool:
                rest, head = s[k.end() :], s[: k.start()].rstrip()
                nxt = re.match(r" ?([a-z']{3,})", rest)
                last = re.search(r"([a-z.]+)$", head)
                return bool(nxt and not k[2] and not _kind_of(nxt[1]) and not self.place(nxt[1], False) and ((last and _kind_of(last[1])) or not re.match(r"\s*(?:,|$)", rest)))
            outer = [k for k in found if not inner(k)]
            civic = (outer or found)[-1]
            if len(outer) > 1:
                civic = next((k for k in outer if re.match(r"n|c", k[0])), outer[0])
        elif found:
            k = found[0]
            head, rest = s[: k.start()].rstrip(), s[k.end() :]
            last, nxt = re.search(r"([a-z.]+)$", head), re.match(r" ([a-z']{4,})", rest)
            part = last and _kind_of(last[1]) and nxt and not self.place(nxt[1], False) and not k[2]
            civic = None if part else k
        number = suffix = ""
        if civic:
            number, suffix = civic[1].lstrip("0") or "0", (civic[2] or "").lower()
            s = s[: civic.start()] + " , " + s[civic.end() :]
        segments, kind = [[]], ""
        tokens = _TOKEN.findall(s)
        for t in tokens:
            if t in ",-();:/":
                segments.append([])
            else:
                segments[-1].append(t)
        words: list[tuple[int, str]] = []
        title, kind_segment, initial, numeral = "", -1, "", ""
        for i, segment in enumerate(segments):
            for j, t in enumerate(segment):
                bare = t.rstrip(".").strip("'")
                if not kind and _kind_of(bare) and (len(bare) > 1 or t.endswith(".") or j == 0):
                    if len(bare) == 1 and j + 1 >= len(segment):
                        continue
                    kind, kind_segment = _kind_of(bare), i
                elif bare in TITLE_OF and not title and not (len(bare) == 1 and not t.endswith(".") and bare not in "ds"):
                    title = TITLE_OF[bare]
                elif bare in TITLE_OF and len(bare) > 1:
                    continue
                elif (value := _numeral(bare)) and j + 1 < len(segment) and segment[j + 1][:1].isalpha():
                    numeral = numeral or value
                elif bare in ("n", "nr", "civico", "di", "del", "della", "civ", "numero") or bare.isdigit() or bare in NUMBER_WORDS:
                    continue
                elif len(bare) < 2:
                    initial = initial or (bare if bare.isalpha() and t.endswith(".") else "")
                elif bare in self.towns:
                    continue
                else:
                    words.append((i, bare))
        rest: list[tuple[int, str]] = []
        known = locality or next((w for _, w in words if w in self.places), "")
        for i, w in words:
            alone = len(segments[i]) == 1 or i != kind_segment
            p = self.place(w, False) or (self.near_place(w, known) if alone and len(words) > 1 else "")
            if p and len(words) - bool(self.given_name(w)) > 1 and not (i == kind_segment and not any(x for j, x in words if (j, x) != (i, w))):
                if p not in self.towns and p != SEVERAL:
                    locality = locality or p
                known = known or p
            else:
                rest.append((i, w))
        if kind_segment >= 0 and any(i == kind_segment for i, _ in rest):
            rest = [(i, w) for i, w in rest if i == kind_segment]
        core = [w for _, w in rest if not self.given_name(w)]
        given = next((self.given_name(w) for _, w in rest if self.given_name(w)), "") or initial
        if not core:
            core, given = [w for _, w in rest], ""
        if not core or not (kind or number):
            return None  # "vedi sito" and the like
        return Address(kind, " ".join(sorted(set(core))), number, suffix, locality, given, numeral, " ".join(sorted(set(core[1:]))))
