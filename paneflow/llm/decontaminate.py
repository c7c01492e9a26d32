"""Benchmark decontamination by template canonicalisation (operator 3).

Texts become tokens: runs of letters, and runs of ASCII digits (with inner points
and commas); which characters are letters and capitals is Unicode's choice. Two
views are matched against the benchmark in windows of WINDOW tokens: the plain one
(lower-cased tokens), and the template one, where numbers and number words, units,
and names (capitalised inside a sentence) are replaced by typed placeholders. The
number words and units are those of all languages of the parameter ``words``,
whatever a row's own language is, as items name none; a unit of one letter counts
after a number only. Template windows need at least LITERALS other tokens. Other
capitalised words (openers of texts, sentences and quotes) may be names or not:
their windows are looked up in both forms, and two of them match as the same
literal, or as names if the item's one stands for one value throughout. A run of
numbers, units or names is one slot of the template, so its length is free.

Documents and items meet by a hash join of windows. An item is dealt by its rarest
windows only, enough of them that no pair to report can miss all: of n windows of
which half must match, any n / 2 + 1 contain one (template windows: a quarter, as
openers may match in two forms); and in every stretch of RUN tokens one more, for
verbatim runs. So windows that many items share, such as common phrases, are dealt
by few. A sieve of fixed size holds back windows of the documents that no item is
dealt by. Each document that has candidates meets their texts as one list, or as
several of at most ASKED_BYTES (and one item), and is compared with these in full.

A pair is reported if in the plain view the document holds at least SHARE of the
item's distinct windows or a verbatim run of RUN tokens of it, or in the template view along one alignment, or several
that follow on each other with shifts at most DRIFT tokens apart, at least SHARE
of them and the slots agree there: each slot value of the item stands for
one value of the document wherever it occurs (a re-parameterised question).

Items of under WINDOW tokens are one whole plain window. Null texts, empty texts and
items without a token match nothing; repeated rows are each reported; items of equal
text too. Very long texts are compared whole, one at a time. Extra columns may have
any names: ``clean`` carries a row as one struct. Empty tables give no pairs.
"""

from __future__ import annotations

import bisect
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paneflow.llm.common import Workspace, as_struct, join_checked, slot_counts, text_chunks
from paneflow.llm.wordhash import LOWER, buffers, combine, mix, runs, span_hash

WINDOW, LITERALS, SHARE = 5, 3, 0.5
DRIFT, RUN = 8, 13
#: Slots (2**SIEVE_BITS bytes, broadcast) of the windows by which items are dealt.
SIEVE_BITS = 22
_PLAIN, _TEMPLATE, _SHORT = (mix(np.array([k], dtype=np.uint64))[0] for k in (11, 12, 13))
FOUND = ("item_id", "plain_share", "template_share", "slots", "changed_slots")
#: Item texts in one row beside a document's text.
ASKED_BYTES = 1 << 18
# Words that count as numbers, and units, by language. Words that are common words of
# another of these languages are left out: ein, un, une, uno, una, once, seize, null, tag, an, mes, livre, media.
WORDS = {
    "en": (
        "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half twice".split(),
        "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds ounce ounces oz ton tons ml l liter liters litre litres gallon gallons second seconds sec s minute minutes min hour hours hr day days week weeks month months year years cent cents dollar dollars usd euro euros eur yen percent degree degrees celsius fahrenheit mph kmh hz khz mhz ghz kb mb gb tb watt watts kw volt volts".split(),
    ),
    "de": (
        "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend million millionen milliarde milliarden halb zweimal dreimal".split()
        + [f"{one}und{ten}" for ten in "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig".split() for one in "ein zwei drei vier fünf sechs sieben acht neun".split()],
        "millimeter zentimeter meter metern kilometer kilometern gramm kilo kilogramm pfund tonne tonnen liter litern milliliter sekunde sekunden minute minuten stunde stunden tage tagen woche wochen monat monate monaten jahr jahre jahren prozent grad cent euro".split(),
    ),
    "fr": (
        "zéro deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze vingt vingts trente quarante cinquante soixante mille million millions milliard milliards demi demie".split(),
        "millimètre millimètres centimètre centimètres mètre mètres kilomètre kilomètres gramme grammes kilo kilos kilogramme kilogrammes tonne tonnes litre litres millilitre millilitres seconde secondes minute minutes heure heures jour jours semaine semaines mois ans année années degré degrés centime centimes euro euros".split(),
    ),
    "es": (
        "cero dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento cientos doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos mil millón millones".split(),
        "milímetro milímetros centímetro centímetros metro metros kilómetro kilómetros gramo gramos kilo kilos kilogramo kilogramos libra libras tonelada toneladas litro litros mililitro mililitros segundo segundos minuto minutos hora horas día días semana semanas meses año años grado grados céntimo céntimos centavo centavos peso pesos euro euros".split(),
    ),
}

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[0x30:0x3A] = True
#: First bytes of capitals, and of all characters of two or three bytes.
_MAY_BE_CAPITAL = np.zeros(256, dtype=bool)
_MAY_BE_CAPITAL[[*range(0x41, 0x5B), *range(0xC2, 0xF0)]] = True
_INNER = np.zeros(256, dtype=bool)
_INNER[[0x2C, 0x2E]] = True
#: Bytes besides letters after which, and a space, a capital letter does not begin a sentence.
_WITHIN = _DIGIT.copy()
_WITHIN[[0x2C, 0x3B]] = True
_SLOT = np.array([0, 0x6E756D, 0x756E6974, 0x6E616D65, 0x6E616D65], dtype=np.uint64)  # literal, number, unit, name, opener


#: What Unicode says of the characters of up to three bytes; combining marks belong to words.
_WORD_CHAR = np.fromiter((chr(c).isalpha() or unicodedata.category(chr(c))[0] == "M" for c in range(1 << 16)), dtype=bool, count=1 << 16)
_CAPITAL = np.fromiter((chr(c).isupper() or chr(c).istitle() for c in range(1 << 16)), dtype=bool, count=1 << 16)
#: Lower-cased characters of two bytes, where that is one such character again.
_SMALL = np.array([ord(c.lower()) if len(c.lower()) == 1 and 0x80 <= ord(c.lower()) < 0x800 else ord(c) for c in map(chr, range(0x800))])


def _decoded(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The characters that begin at some bytes, 0 for those of four bytes."""
    first = raw[at].astype(np.int32)
    follow = [raw[np.minimum(at + k, len(raw) - 1)].astype(np.int32) & 0x3F for k in (1, 2)]
    two, three = (first & 0x1F) << 6 | follow[0], (first & 0x0F) << 12 | follow[0] << 6 | follow[1]
    return np.select([first < 0x80, first < 0xE0, first < 0xF0], [first, two, three], 0)


def _lower(raw: np.ndarray) -> np.ndarray:
    """The bytes of the texts with A-Z and characters of two bytes lower-cased."""
    out = LOWER[raw]
    at = np.flatnonzero((raw >= 0xC3) & (raw < 0xE0))
    if len(at):
        char = _decoded(raw, at)
        small = _SMALL[char]
        at, small = at[small != char], small[small != char]
        out[at], out[at + 1] = 0xC0 | small >> 6, 0x80 | small & 0x3F
    return out


def _letters(raw: np.ndarray) -> np.ndarray:
    """Which bytes are of letters; characters of four bytes are."""
    out = _LETTER[raw]
    at = np.flatnonzero((raw >= 0xC2) & (raw < 0xF0))
    if len(at):
        other = at[~_WORD_CHAR[_decoded(raw, at)]]
        out[other] = out[other + 1] = False
        other = other[raw[other] >= 0xE0]
        out[other + 2] = False
    return out


@dataclass(frozen=True)
class Lexicon:
    """Sorted hashes of the words that count as numbers and as units, and the bytes of the longest."""

    numbers: np.ndarray
    units: np.ndarray
    longest: int

    @classmethod
    def of(cls, words: dict[str, tuple[list[str], list[str]]]) -> Lexicon:
        listed = [sorted({w for pair in words.values() for w in pair[k]}) for k in (0, 1)]
        hashed = []
        for some in listed:
            data, offs = buffers(pa.array(some, pa.large_string()))
            hashed.append(np.sort(span_hash(_lower(data), offs[:-1], offs[1:])))
        return cls(*hashed, max((len(w.encode()) for some in listed for w in some), default=0))


def _in(sorted_keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(x), dtype=bool)
    at = np.minimum(np.searchsorted(sorted_keys, x), len(sorted_keys) - 1)
    return sorted_keys[at] == x


LEXICON = Lexicon.of(WORDS)


def canonical(texts: pa.Array, lexicon: Lexicon = LEXICON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, its slot type, first token of each row)."""
    raw, offs = buffers(texts)
    digit, letter, n = _DIGIT[raw], _letters(raw), len(raw)
    inner = np.flatnonzero(_INNER[raw])
    inner = inner[(inner > 0) & (inner < n - 1)]
    inner = inner[digit[inner - 1] & digit[inner + 1]]
    digit[inner] = True
    (ls, le), (ds, de) = runs(letter, offs), runs(digit, offs)
    starts, ends = np.concatenate([ls, ds]), np.concatenate([le, de])
    kind = np.concatenate([np.zeros(len(ls), dtype=np.int8), np.ones(len(ds), dtype=np.int8)])
    order = np.argsort(starts, kind="stable")
    starts, ends, kind = starts[order], ends[order], kind[order]
    h = span_hash(_lower(raw), starts, ends)
    bounds = np.searchsorted(starts, offs)
    short = np.flatnonzero((kind == 0) & (ends - starts <= lexicon.longest))
    kind[short[_in(lexicon.numbers, h[short])]] = 1
    kind[short[_in(lexicon.units, h[short])]] = 2
    # a letter alone is a unit after a number of the same row only
    alone = np.flatnonzero((kind == 2) & (ends - starts == 1))
    kind[alone[np.isin(alone, bounds) | (kind[alone - 1] != 1)]] = 0
    upper = np.flatnonzero((kind == 0) & _MAY_BE_CAPITAL[raw[starts]]) if n else starts
    if len(upper):
        upper = upper[_CAPITAL[_decoded(raw, starts[upper])]]
    first = np.repeat(offs[:-1], np.diff(bounds))[upper]
    kind[upper] = 4
    upper = upper[starts[upper] - first >= 2]
    at = starts[upper]
    kind[upper[(raw[at - 1] == 0x20) & (letter | _WITHIN[raw])[at - 2]]] = 3
    return h, kind, bounds


def collapse(h: np.ndarray, kind: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens with each run of numbers, units or names in a row as one, hashed over the whole run."""
    if not len(h):
        return h, kind, bounds
    keep = np.ones(len(h), dtype=bool)
    keep[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 0) | (kind[1:] == 4)
    keep[bounds[:-1][bounds[:-1] < len(h)]] = True
    heads = np.flatnonzero(keep)
    place = np.arange(len(h)) - np.repeat(heads, np.diff(np.append(heads, len(h))))
    parts = np.where(keep, h, mix(h + place.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)))
    return np.add.reduceat(parts, heads), kind[heads], np.concatenate([[0], np.cumsum(keep)])[bounds]


def _chain(q: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most pairs (q, p) in which both rise strictly."""
    order = np.lexsort((-p, q))
    q, p = q[order].tolist(), p[order].tolist()
    tails: list[int] = []
    ends: list[int] = []
    before = []
    for k, x in enumerate(p):
        at = bisect.bisect_left(tails, x)
        before.append(ends[at - 1] if at else -1)
        tails[at : at + 1] = [x]
        ends[at : at + 1] = [k]
    chosen, k = [], ends[-1] if ends else -1
    while k >= 0:
        chosen.append(k)
        k = before[k]
    chosen.reverse()
    return np.array([q[k] for k in chosen], dtype=np.int64), np.array([p[k] for k in chosen], dtype=np.int64)


def _held(marked: np.ndarray) -> np.ndarray:
    """How many of each window's tokens are marked."""
    upto = np.concatenate([[0], np.cumsum(marked)])
    return upto[WINDOW:] - upto[:-WINDOW]


def _alike(h, kind, h2, kind2) -> tuple[np.ndarray, np.ndarray]:
    """(which of the aligned tokens match, which of them as slots)."""
    typed = (kind == kind2) & (kind > 0) & (kind < 4)
    alike = typed | ((h == h2) & (kind % 4 == 0) & (kind2 % 4 == 0))
    names = (kind >= 3) & (kind2 >= 3)
    wild = names & ~alike
    if wild.any():
        # an opener is a name only if it stands for one value
        pairs = np.unique(np.stack([h[names], h2[names]]), axis=1)
        value, n = np.unique(pairs[0], return_counts=True)
        wild &= ~np.isin(h, value[n > 1])
    return alike | wild, typed | wild


def _windows(h: np.ndarray, kind: np.ndarray, bounds: np.ndarray, view: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows inside rows, and their first tokens; view 0 is plain, 1 the template, 2 its windows without a slot."""
    if len(h) < WINDOW:
        return h[:0], np.zeros(0, dtype=np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    good = row[: len(h) - WINDOW + 1] == row[WINDOW - 1 :]
    if not view:
        at = np.flatnonzero(good)
        return combine(h, WINDOW)[at], at
    if view == 2:
        at = np.flatnonzero(good & (_held((kind > 0) & (kind < 4)) == 0))
        return combine(h, WINDOW)[at], at
    forms = []
    openers = _held(kind == 4)
    # openers as literals, then as names
    for slot, some in (((kind > 0) & (kind < 4), good), (kind > 0, good & (openers > 0))):
        held = _held(slot)
        at = np.flatnonzero(some & (held > 0) & (held <= WINDOW - LITERALS))
        forms.append((combine(np.where(slot, _SLOT[kind], h), WINDOW)[at], at))
    return tuple(map(np.concatenate, zip(*forms, strict=True)))


class Index:
    """Windows of some items, by hash, in both views: compares texts with them in full.

    With ``rows`` each item is compared with the text of its row alone: the hashes of
    its windows, and of the windows of that text, are changed by the row's own mark.
    """

    def __init__(self, item_ids: list, texts: list, rows: np.ndarray | None = None, lexicon: Lexicon = LEXICON):
        self.items, self.lexicon, self.by_row = item_ids, lexicon, rows is not None
        self.h, self.kind, self.bounds = canonical(pa.array([t or "" for t in texts], pa.large_string()), lexicon)
        marks = self._marks(rows) if self.by_row else np.zeros(len(texts), dtype=np.uint64)
        self.template = collapse(self.h, self.kind, self.bounds)
        self.views = []
        for view in (0, 1, 2):
            tokens = self.template if view else (self.h, self.kind, self.bounds)
            keys, at = _windows(*tokens, view)
            item = np.searchsorted(tokens[2], at, side="right") - 1
            keys = keys ^ marks[item]
            order = np.argsort(keys, kind="stable")
            keys, at, item = keys[order], at[order], item[order]
            sieve = np.zeros(1 << 20, dtype=bool)
            sieve[keys >> np.uint64(44)] = True
            self.views.append((keys, at, item, sieve))
        # distinct plain windows, and all positions of the template, of each item
        keys, _, item, _ = self.views[0]
        pairs = np.unique(np.stack([item.astype(np.uint64), keys]), axis=1) if len(keys) else np.zeros((2, 0), np.uint64)
        self.distinct = np.bincount(pairs[0].astype(np.int64), minlength=len(texts))
        self.places = np.maximum(0, np.diff(self.template[2]) - WINDOW + 1)

        # items of fewer tokens than a window, by their number of tokens
        n = np.diff(self.bounds)
        self.short = []
        for k in range(1, WINDOW):
            if len(some := np.flatnonzero(n == k)):
                keys = combine(self.h, k)[self.bounds[some]] ^ marks[some]
                order = np.argsort(keys, kind="stable")
                self.short.append((k, keys[order], some[order]))

    @staticmethod
    def _marks(rows: np.ndarray) -> np.ndarray:
        return mix(rows.astype(np.uint64) + np.uint64(1))

    def _own(self, w: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The hashes of windows of texts as those of the items that these rows are compared with."""
        return w ^ self._marks(row) if self.by_row else w

    def _short(self, h, bounds, found) -> None:
        """The rows that hold a short item as a whole."""
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for k, keys, item in self.short:
            w = combine(h, k)
            w = self._own(w, row[: len(w)])
            p = np.flatnonzero(_in(keys, w) & (row[: len(w)] == row[k - 1 :])) if len(w) else np.zeros(0, dtype=np.int64)
            lo = np.searchsorted(keys, w[p], "left")
            n = np.searchsorted(keys, w[p], "right") - lo
            entry = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            for r, i in np.unique(np.stack([np.repeat(row[p], n), item[entry]]), axis=1).T:
                found[int(r), int(i)] = [1.0, 0.0, 0, 0]

    def _hits(self, h, kind, bounds, view):
        """(token of the document, index entry) of all equal windows."""
        keys, at, item, sieve = self.views[view]
        w, p = _windows(h, kind, bounds, view)
        w = self._own(w, np.searchsorted(bounds, p, side="right") - 1)
        some = np.flatnonzero(sieve[w >> np.uint64(44)])
        w, p = w[some], p[some]
        lo, hi = np.searchsorted(keys, w, "left"), np.searchsorted(keys, w, "right")
        n = hi - lo
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else lo
        return np.repeat(p, n), entry.astype(np.int64)

    def find(self, texts: pa.Array) -> list[tuple[int, int, float, float, int, int]]:
        """(row, item, plain share, template share, slots, changed slots) of the pairs to report."""
        h, kind, bounds = canonical(texts, self.lexicon)
        found: dict[tuple[int, int], list] = {}
        p, e = self._hits(h, kind, bounds, 0)
        if len(p):
            keys, _, item, _ = self.views[0]
            row = np.searchsorted(bounds, p, side="right") - 1
            seen = np.unique(np.stack([row.astype(np.uint64), item[e].astype(np.uint64), keys[e]]), axis=1)
            pair, n = np.unique(seen[:2].astype(np.int64), axis=1, return_counts=True)
            # verbatim runs: windows that follow on each other along one alignment
            q = self.views[0][1][e]
            a, b, d, at = (x[np.lexsort((p, p - q, item[e], row))] for x in (row, item[e], p - q, p))
            new = np.flatnonzero(np.append(True, (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(d) != 0) | (np.diff(at) != 1)))
            long = new[np.diff(np.append(new, len(at))) + WINDOW - 1 >= RUN]
            copied = set(zip(a[long].tolist(), b[long].tolist(), strict=True))
            for r, i, c in zip(*pair, n, strict=True):
                if (share := c / self.distinct[i]) >= SHARE or (int(r), int(i)) in copied:
                    found[int(r), int(i)] = [float(share), 0.0, 0, 0]
        self._short(h, bounds, found)
        h, kind, bounds = collapse(h, kind, bounds)
        p, e = self._hits(h, kind, bounds, 1)
        if len(p):
            self._template(h, kind, bounds, p, e, found)
        return [(r, i, *x) for (r, i), x in sorted(found.items())]

    def _template(self, h, kind, bounds, p, e, found) -> None:
        _, at, item, _ = self.views[1]
        q, it = at[e], item[e]
        row = np.searchsorted(bounds, p, side="right") - 1
        # windows without a slot show further alignments of those pairs
        p2, e2 = self._hits(h, kind, bounds, 2)
        row2, it2 = np.searchsorted(bounds, p2, side="right") - 1, self.views[2][2][e2]
        n = len(self.places)
        some = np.isin(row2 * n + it2, row * n + it)
        row, it = np.concatenate([row, row2[some]]), np.concatenate([it, it2[some]])
        shift = np.concatenate([p - q, p2[some] - self.views[2][1][e2[some]]])
        # one alignment: the same row, item and distance
        lines = np.unique(np.stack([row, it, shift]), axis=1)
        apart = np.any(lines[:2, 1:] != lines[:2, :-1], axis=0) | (np.diff(lines[2]) > DRIFT)
        for group in np.split(lines, np.flatnonzero(apart) + 1, axis=1):
            r, i = int(group[0, 0]), int(group[1, 0])
            full = [self._full(h, kind, bounds, r, i, s) for s in group[2]]
            best = None
            for s, x in zip(group[2], full, strict=True):
                best = max(filter(None, (best, self._share(h, kind, i, x, x + s))), default=None)
            if best is None and len(full) > 1 and sum(map(len, full)) >= SHARE * self.places[i]:
                best = self._share(h, kind, i, *_chain(np.concatenate(full), np.concatenate([x + s for s, x in zip(group[2], full, strict=True)])))
            if best:
                have = found.setdefault((r, i), [0.0, 0.0, 0, 0])
                if best[0] > have[1]:
                    have[1:] = best

    def _full(self, h, kind, bounds, r, i, shift) -> np.ndarray:
        """First tokens in the item of the windows that match along one alignment."""
        own, types, places = self.template
        lo, hi = max(places[i], bounds[r] - shift), min(places[i + 1], bounds[r + 1] - shift)
        if hi - lo < WINDOW:
            return np.zeros(0, dtype=np.int64)
        alike, _ = _alike(own[lo:hi], types[lo:hi], h[lo + shift : hi + shift], kind[lo + shift : hi + shift])
        return lo + np.flatnonzero(_held(alike) == WINDOW)

    def _share(self, h, kind, i, q, p) -> tuple[float, int, int] | None:
        """(share, slots, changed slots) of the matching windows from q and p on, if enough and consistent."""
        share = len(q) / self.places[i]
        if not len(q) or share < SHARE:
            return None
        own, types, _ = self.template
        step = np.arange(WINDOW)
        mine, at = np.unique(q[:, None] + step, return_index=True)
        theirs = (p[:, None] + step).ravel()[at]
        _, slot = _alike(own[mine], types[mine], h[theirs], kind[theirs])
        pairs = np.unique(np.stack([own[mine][slot], h[theirs][slot]]), axis=1)
        if len(np.unique(pairs[0])) < pairs.shape[1]:
            return None
        return float(share), int(slot.sum()), int((pairs[0] != pairs[1]).sum())


def _plain(h: np.ndarray, bounds: np.ndarray, shorts: range) -> tuple[np.ndarray, np.ndarray]:
    """(key, first token) of the plain windows inside rows, and of the runs of fewer tokens of the lengths ``shorts``."""
    keys, places = [], []
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    for k in (WINDOW, *shorts):
        at = np.flatnonzero(row[: max(0, len(h) - k + 1)] == row[k - 1 :])
        keys.append(mix(combine(h, k)[at] ^ (_PLAIN if k == WINDOW else _SHORT ^ np.uint64(k))))
        places.append(at)
    return np.concatenate(keys), np.concatenate(places)


def _template(h: np.ndarray, kind: np.ndarray, bounds: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(key, first token) of the template windows: openers as literals, then as names.

    ``whole`` wants the places alone at which no reading has too many slots, in both forms.
    """
    if len(h) < WINDOW:
        return h[:0], np.zeros(0, dtype=np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    good = row[: len(h) - WINDOW + 1] == row[WINDOW - 1 :]
    few = _held(kind > 0) <= WINDOW - LITERALS
    keys, places = [], []
    for slot, some in (((kind > 0) & (kind < 4), good & few if whole else good & (_held((kind > 0) & (kind < 4)) <= WINDOW - LITERALS)), (kind > 0, good & few & (_held(kind == 4) > 0))):
        at = np.flatnonzero(some)
        keys.append(mix(combine(np.where(slot, _SLOT[kind], h), WINDOW)[at] ^ _TEMPLATE))
        places.append(at)
    return np.concatenate(keys), np.concatenate(places)


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    """The slots of keys among ``size`` of them, a power of 2."""
    return (keys >> np.uint64(65 - size.bit_length())).astype(np.int64)


def item_keys(text: str, counts: np.ndarray | None, lexicon: Lexicon = LEXICON) -> np.ndarray:
    """The keys of an item; with ``counts`` of the slots of all items' keys, those by which it is dealt."""
    h, kind, bounds = canonical(pa.array([text], pa.large_string()), lexicon)
    if len(h) < WINDOW:
        return _plain(h, bounds, range(len(h), len(h) + 1))[0] if len(h) else h
    plain, _ = _plain(h, bounds, range(0))
    form, place = _template(*collapse(h, kind, bounds), True)
    if counts is None:
        return np.concatenate([plain, form])
    dealt = []
    # plain: of the distinct windows all but half, and the rarest in each run of RUN tokens
    rank = np.lexsort((plain, counts[_slots(plain, len(counts))]))
    distinct = plain[rank][np.append(True, plain[rank][1:] != plain[rank][:-1])]
    dealt.append(distinct[: len(distinct) - int(np.ceil(SHARE * len(distinct))) + 1])
    order = np.empty(len(plain), dtype=np.int64)
    order[rank] = np.arange(len(plain))
    span = RUN - WINDOW + 1
    if len(order) > span:
        dealt.append(plain[rank[np.lib.stride_tricks.sliding_window_view(order, span).min(axis=1)]])
    # template: of the places that can be keyed, all but as many as a quarter of all places leaves
    places = max(0, len(collapse(h, kind, bounds)[0]) - WINDOW + 1)
    some, at = np.unique(place, return_inverse=True)
    often = np.zeros(len(some), dtype=np.int64)
    np.maximum.at(often, at, counts[_slots(form, len(counts))].astype(np.int64))
    need = int(np.ceil(SHARE / 2 * places)) - (places - len(some))
    chosen = np.lexsort((some, often))[: len(some) - max(0, need - 1)]
    dealt.append(form[np.isin(at, chosen)])
    return np.unique(np.concatenate(dealt))


def _items(benchmark: DataFrame, space: Workspace, item_col: str, text_col: str) -> DataFrame:
    """The written (number, item, text) of the items with a text."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    return space.table(rows.withColumn("number", F.monotonically_increasing_id()), "items")


def _dealt(items: DataFrame, space: Workspace, lexicon: Lexicon) -> DataFrame:
    """The written (key, number): the windows by which each item is dealt."""
    size = 1 << SIEVE_BITS
    counts = slot_counts(items.select("text"), lambda batch: (_slots(np.unique(item_keys(t, None, lexicon)), size) for t in batch.column("text").to_pylist()), SIEVE_BITS)
    held = space.spark.sparkContext.broadcast(counts)

    def task(batches):
        for batch in batches:
            keys = [item_keys(t, held.value, lexicon) for t in batch.column("text").to_pylist()]
            numbers = np.repeat(batch.column("number").to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_pydict({"key": pa.array(np.concatenate([np.zeros(0, np.uint64), *keys]).astype(np.int64)), "number": pa.array(numbers, pa.int64())})

    return space.table(items.select("number", "text").mapInArrow(task, "key long, number long"), "dealt")


def candidates(docs: DataFrame, items: DataFrame, space: Workspace, lexicon: Lexicon = LEXICON) -> DataFrame:
    """The written (doc_id, mark, number): documents of ``docs`` (doc_id, mark, text) and items that share a window by which the item is dealt."""
    dealt = _dealt(items, space, lexicon)
    size = 1 << SIEVE_BITS
    sieve = slot_counts(dealt, lambda batch: [_slots(batch.column("key").to_numpy().view(np.uint64), size)], SIEVE_BITS) > 0
    held = space.spark.sparkContext.broadcast(sieve)

    def task(batches):
        for batch in batches:
            for first, last, texts in text_chunks(batch, "text"):
                h, kind, bounds = canonical(texts, lexicon)
                short = collapse(h, kind, bounds)
                found = []
                for keys, at, ends in ((*_plain(h, bounds, range(1, WINDOW)), bounds), (*_template(*short, False), short[2])):
                    some = np.flatnonzero(held.value[_slots(keys, size)])
                    found.append(np.stack([np.searchsorted(ends, at[some], "right").astype(np.uint64) - np.uint64(1), keys[some]]))
                row, keys = np.unique(np.concatenate(found, axis=1), axis=1)
                part = batch.slice(first, last - first).select(["doc_id", "mark"]).take(pa.array(row.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys.astype(np.int64))], names=["doc_id", "mark", "key"])

    met = space.table(docs.mapInArrow(task, f"doc_id {dict(docs.dtypes)['doc_id']}, mark long, key long"), "met")
    return space.table(join_checked(met, dealt, "key").select("doc_id", "mark", "number").distinct(), "candidates")


def _same_row(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["doc_id2"]) & (left["mark"] == right["mark2"])


def _asked(pairs: DataFrame, items: DataFrame, space: Workspace) -> DataFrame:
    """The written (doc_id2, mark2, asked): the (item, text) that each document is compared with, in lists of at most ASKED_BYTES and one item."""
    each = pairs.join(items.hint("merge"), "number")
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("doc_id", "mark").orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    listed = each.withColumn("part", F.floor((upto - F.octet_length("text")) / ASKED_BYTES)).groupBy("doc_id", "mark", "part").agg(F.collect_list(F.struct("item", "text")).alias("asked"))
    return space.table(listed.select(F.col("doc_id").alias("doc_id2"), F.col("mark").alias("mark2"), "asked"), "asked")


def _rows_of(lists: pa.Array) -> np.ndarray:
    """The row of each member of some lists."""
    return np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))


def _find(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str, words: dict) -> DataFrame:
    """The reported pairs of ``docs`` (doc_id, mark, text), with ``mark``."""
    space, lexicon = Workspace(docs.sparkSession, "decontaminate"), Lexicon.of(words)
    items = _items(benchmark, space, item_col, item_text)
    pairs = candidates(docs, items, space, lexicon)
    asked = _asked(pairs, items, space)
    # keys alone may be broadcast; texts meet by a shuffle, of the documents with candidates only
    keys = asked.select("doc_id2", "mark2").distinct()
    some = join_checked(docs, keys, _same_row(docs, keys), "left_semi")
    rows = some.join(asked.hint("merge"), _same_row(some, asked)).select("doc_id", "mark", "text", "asked")
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)[item_col]

    def task(batches):
        for batch in batches:
            row = _rows_of(batch.column("asked"))
            size = pc.binary_length(pc.list_flatten(batch.column("asked")).field("text")).to_numpy(zero_copy_only=False)
            for first, last, texts in text_chunks(batch, "text", beside=np.bincount(row, size, batch.num_rows).astype(np.int64)):
                part = batch.slice(first, last - first)
                listed, row = pc.list_flatten(part.column("asked")), _rows_of(part.column("asked"))
                index = Index(listed.field("item").to_pylist(), listed.field("text").to_pylist(), row, lexicon)
                if found := index.find(texts):
                    row, item, *rest = map(list, zip(*found, strict=True))
                    ids = part.select(["doc_id", "mark"]).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*ids.columns, listed.field("item").take(pa.array(item)), pa.array(rest[0]), pa.array(rest[1]), pa.array(rest[2], pa.int32()), pa.array(rest[3], pa.int32())], names=["doc_id", "mark", *FOUND])

    return rows.mapInArrow(task, f"doc_id {kinds[0]}, mark long, item_id {kinds[1]}, plain_share double, template_share double, slots int, changed_slots int")


def _marked(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"), *more)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: dict = WORDS) -> DataFrame:
    """The reported pairs: doc_id, item_id, plain_share, template_share, slots, changed_slots.

    ``words`` has the number words and the units of each language, lower-cased.
    """
    return _find(_marked(docs, id_col, text_col), benchmark, item_col, item_text, words).drop("mark")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: dict = WORDS) -> DataFrame:
    """``docs`` without the rows that hold an item of the benchmark."""
    found = _find(_marked(docs, id_col, text_col), benchmark, item_col, item_text, words).select(F.col("doc_id").alias("doc_id2"), F.col("mark").alias("mark2")).distinct()
    gone = Workspace(docs.sparkSession, "contaminated").table(found, "rows")
    rows = _marked(docs, id_col, text_col, as_struct(docs).alias("row")).drop("text")
    return join_checked(rows, gone, _same_row(rows, gone), "left_anti").select("row.*")
