"""Technical tokens: replaced by placeholders before a text is changed, restored after.

A scanner walks through a text's words and symbols once. Small readers (a number, a
unit, blanks, a style mark) say where something that begins at a place may end, and
``KINDS`` puts them together; where two kinds claim the same characters, the one that
stands earlier in ``KINDS`` has them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import accumulate
from string import ascii_letters, digits

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Unit names and identifiers (fixed values), with the letters omega and mu for their signs.
LENGTHS = frozenset("mm cm m nm μm um in mil".split())
ELECTRIC = frozenset("MΩ kΩ Ω μA uA mA μV uV mV V ns μs us ms °C ℃ dB kHz MHz Hz SPS pF nF μF uF %".split())
#: After a number; between slashes; by themselves.
AMOUNTS = ELECTRIC | LENGTHS | {"s", "nA", "mW", "W"}
RATES = ELECTRIC | {"s", "LSB", "ppm", "FSR", "DIV"}
ALONE = ELECTRIC | {"nA", "mW", "W", "LSB", "ppm", "FSR", "DIV"}
NAMES = frozenset(
    "vdd vss vcc vref vin vout vih vil voh vol gnd iol ioh isink il ih ta tj ts tstg fcm dr pga adc "
    "i2c uart scl sda addr alert rdy gpio ttl div fs lsb ppm".split()
)
LETTERS = frozenset({"R", "RA", "RB", "RC", "C"})

_SIGNS = str.maketrans("\u00b5\u2126", "\u03bc\u03a9")
_ITEM = re.compile(r"[A-Za-z0-9_]+|[^\sA-Za-z0-9_]")
_RUN = re.compile(r"[A-Za-z]+")
_WORD, _PART = re.compile(r"[A-Za-z0-9_]+"), re.compile(r"[A-Za-z0-9]+")
_LETTERS = frozenset(ascii_letters)
_WORDLY = frozenset(ascii_letters + digits + "_")
_MARK = re.compile(r"\{[^{}\s]+\}|</?[bB]\d+>")
_LOWER = {units: frozenset(u.lower() for u in units) for units in (LENGTHS, AMOUNTS, RATES, ALONE)}
_FIRST = {units: frozenset(u[0] for u in lower) for units, lower in _LOWER.items()}
#: Words that may begin a token; other words of letters alone are passed over.
_KNOWN = NAMES | _LOWER[AMOUNTS] | _LOWER[RATES] | _LOWER[ALONE]

Ends = Iterator[int]


class Scan:
    """One text. Offsets are those of the text; ``at`` is it with one spelling of each sign."""

    def __init__(self, text: str):
        self.at = text.translate(_SIGNS)
        self.marks = {m.start(): m.end() for m in _MARK.finditer(text)}
        # A kind whose sign the text doesn't have needs no look at any place.
        self.slash, self.equal, self.low_line = "/" in self.at, "=" in self.at, "_" in self.at

    # ---- what stands next to a place

    def letter(self, p: int) -> bool:
        """Whether an unaccented letter stands there."""
        return 0 <= p < len(self.at) and self.at[p] in _LETTERS

    def digit(self, p: int) -> bool:
        return p < len(self.at) and self.at[p].isdecimal()

    def wordly(self, p: int) -> bool:
        """Whether an unaccented letter, a digit or a low line stands there."""
        return 0 <= p < len(self.at) and self.at[p] in _WORDLY

    # ---- readers

    def blank(self, p: int) -> int:
        while p < len(self.at) and self.at[p].isspace():
            p += 1
        return p

    def sign(self, p: int, signs: str) -> int:
        return p + (self.at[p : p + 1] in signs and p < len(self.at))

    def word(self, p: int, low_line: bool) -> int:
        found = (_WORD if low_line else _PART).match(self.at, p)
        return found.end() if found else p

    def number(self, p: int, bare: bool) -> Ends:
        """Digits with or without a fraction; ``bare``: a fraction alone will do."""
        end = p
        while self.digit(end):
            end += 1
        if self.at[end : end + 1] in (".", ",") and self.digit(end + 1) and (end > p or bare):
            part = end + 1
            while self.digit(part):
                part += 1
            yield part
        if end > p:
            yield end

    def unit(self, p: int, units: frozenset, any_case: bool) -> Ends:
        if self.at[p : p + 1].lower()[:1] not in _FIRST[units]:
            return
        for n in (3, 2, 1):
            name = self.at[p : p + n]
            if len(name) == n and (name.lower() in _LOWER[units] if any_case else name in units):
                yield p + n

    def quantity(self, p: int, units: frozenset, any_case: bool, bare: bool) -> Ends:
        for q in self.number(p, bare):
            yield from self.unit(self.blank(q), units, any_case)

    # ---- kinds of tokens: the end of one that begins at p, or 0

    def equation(self, p: int) -> int:
        if not self.equal:
            return 0
        end = self.word(p, True)
        q = self.blank(end)
        if not self.letter(p) or self.wordly(p - 1) or end - p > 16 or self.at[q : q + 1] != "=":
            return 0
        q = self.sign(self.blank(q + 1), "-+±")
        return next((e for e in self.quantity(q, AMOUNTS, True, False) if not self.wordly(e)), 0)

    def marked_name(self, p: int) -> int:
        """Parts of a name with a style mark between each two."""
        if not self.marks:
            return 0
        end = self.word(p, False)
        part, found = self.at[p:end], 0
        capital = lambda s: s[:1].isalpha() and s.isupper()
        if self.wordly(p - 1) and self.at[p - 1] != "_" or not (capital(part) or len(part) == 3 and part[0].isalpha() and part[1].isdigit() and part[2].isalpha()):
            return 0
        while end in self.marks:
            p = self.marks[end]
            end = self.word(p, False)
            part = self.at[p:end]
            if not (capital(part) or part.isdigit() or len(part) == 1):
                break
            found = end
        return found

    def _sizes(self, p: int, bridge: Callable[[int], int], any_case: bool, bare: bool) -> int:
        """The end of as many sizes as there are, each over a bridge from the one before; at least one."""
        q = bridge(p)
        if q < 0:
            return 0
        for e in self.quantity(self.sign(q, "-+"), LENGTHS, any_case, bare):
            if further := self._sizes(e, bridge, any_case, bare):
                return further
            if not self.letter(e):
                return e
        return 0

    def _over_marks(self, p: int) -> int:
        q = self.blank(p)
        if q not in self.marks:
            return -1
        while q in self.marks:
            q = self.marks[q]
        return self.blank(q)

    def _over_times(self, p: int) -> int:
        q = self.blank(p)
        return self.blank(q + 1) if self.at[q : q + 1] in ("×", "x", "X", "*") else -1

    def marked_sizes(self, p: int) -> int:
        if not self.marks or self.wordly(p - 1):
            return 0
        return max((self._sizes(e, self._over_marks, True, True) for e in self.quantity(self.sign(p, "-+"), LENGTHS, True, False)), default=0)

    def sizes(self, p: int) -> int:
        if self.wordly(p - 1):
            return 0
        return max((self._sizes(e, self._over_times, False, False) for e in self.quantity(self.sign(p, "-+"), LENGTHS, False, False)), default=0)

    def _rates(self, p: int, before: int) -> int:
        for e in self.unit(p, RATES, True):
            ends = [e]
            q = self.blank(e)
            if q > e and self.at[q : q + 2].lower() == "of":
                r = self.blank(q + 2)
                if r > q + 2 and self.at[r : r + 3].lower() == "fsr":
                    ends.insert(0, r + 3)
            for f in ends:
                if self.at[f : f + 1] == "/" and (further := self._rates(f + 1, before + 1)):
                    return further
                if before and not self.letter(f):
                    return f
        return 0

    def ratio(self, p: int) -> int:
        return 0 if not self.slash or self.letter(p - 1) else self._rates(p, 0)

    def amount(self, p: int) -> int:
        if self.wordly(p - 1):
            return 0
        for e in self.quantity(self.sign(p, "-+±"), AMOUNTS, False, True):
            if self.at[e : e + 1] == "/":
                for f in self.unit(e + 1, RATES, False):
                    if not self.letter(f):
                        return f
            if not self.letter(e):
                return e
        return 0

    def compound(self, p: int) -> int:
        """Capital words, and numbers after the first, joined by low lines."""
        if not self.low_line:
            return 0
        end = self.word(p, False)
        if self.wordly(p - 1) and self.at[p - 1] != "_" or not _capitals(self.at[p:end]):
            return 0
        found = 0
        while self.at[end : end + 1] == "_":
            q = end + 1
            end = self.word(q, False)
            if not (_capitals(self.at[q:end]) or self.at[q:end].isdigit()):
                break
            found = end
        return found

    def name(self, p: int) -> int:
        end = self.word(p, True)
        inside = lambda k: 0 <= k < len(self.at) and (self.at[k].isalnum() or self.at[k] == "_")
        return end if self.at[p:end].lower() in NAMES and not inside(p - 1) and not inside(end) else 0

    def single(self, p: int) -> int:
        return next((p + n for n in (2, 1) if self.at[p : p + n] in LETTERS and len(self.at) >= p + n and not self.letter(p - 1) and not self.letter(p + n)), 0)

    def alone(self, p: int) -> int:
        return 0 if self.letter(p - 1) else next((e for e in self.unit(p, ALONE, True) if not self.letter(e)), 0)


def _capitals(part: str) -> bool:
    return part[:2].isalpha() and len(part) > 1 and part.isupper()


#: Kinds of tokens in order of precedence.
KINDS = (Scan.equation, Scan.marked_name, Scan.marked_sizes, Scan.sizes, Scan.ratio, Scan.amount, Scan.compound, Scan.name, Scan.single, Scan.alone)
#: Those that may begin inside a word, at a run of letters or after a low line; with a number; with a symbol.
_INSIDE = (1, 4, 6, 8, 9)
_NUMERIC = (2, 3, 5)
_SYMBOL = (4, 9)


def _starts(scan: Scan) -> Iterator[tuple[int, tuple[int, ...]]]:
    """Places at which tokens may begin, and of which kinds, in order of the places."""
    skip = 0
    for m in _ITEM.finditer(scan.at):
        p, word = m.start(), m.group()
        if p < skip:
            continue
        if p in scan.marks:
            skip = scan.marks[p]
        elif not word[0].isascii() or not (word[0].isalnum() or word[0] == "_"):
            if word in "+-±.,":
                yield p, _NUMERIC
            elif word in "μΩ°℃%":
                yield p, _SYMBOL
        elif word.isalpha():
            after = scan.at[m.end() : m.end() + 1]
            if scan.equal or scan.marks or word.lower() in _KNOWN or word in LETTERS or not after.isascii():
                yield p, (0, 1, 4, 7, 8, 9)
        else:
            yield p, (0, 7, *_NUMERIC) if word[0].isdecimal() else (0, 7)
            at = {p, *(k + 1 for k, c in enumerate(word[:-1], p) if c == "_"), *(r.start() + p for r in _RUN.finditer(word))}
            yield from ((k, _INSIDE) for k in sorted(at))


def spans(text: str) -> list[tuple[int, int]]:
    """Where the tokens of a text begin and end, in order; none begins inside a style mark."""
    scan = Scan(text)
    found: list[list[tuple[int, int]]] = [[] for _ in KINDS]
    last = [0] * len(KINDS)
    for p, kinds in _starts(scan):
        for k in kinds:
            if p >= last[k] and (end := KINDS[k](scan, p)):
                found[k].append((p, end))
                last[k] = end
    taken, out = bytearray(len(text)), []
    for spans_of_kind in found:
        for a, b in spans_of_kind:
            if not any(taken[a:b]):
                taken[a:b] = b"\x01" * (b - a)
                out.append((a, b))
    return sorted(out)


def protect_text(text: str) -> tuple[str, list[tuple[str, str]]]:
    """The text with a placeholder for each token, and (placeholder, token) pairs in order.

    A placeholder's name (a fixed format) is made from its number, place and token, so
    that it doesn't depend on anything else and no token looks like it.
    """
    pairs, parts, rest = [], [], 0
    for number, (a, b) in enumerate(spans(text)):
        key = ":".join([str(number), str(a), str(b), text[a:b]])
        pairs.append(("DTX" + hashlib.sha1(key.encode()).hexdigest()[:10].upper() + "Q", text[a:b]))
        parts.append(text[rest:a] + pairs[-1][0])
        rest = b
    return "".join(parts) + text[rest:], pairs


TOKEN = T.StructType([T.StructField("name", T.StringType()), T.StructField("token", T.StringType())])
PROTECTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("tokens", T.ArrayType(TOKEN))])


#: Texts whose Python values are held at once.
PART = 64


def by_part(texts: pa.Array, rule: Callable[[str | None], object], kind: pa.DataType) -> pa.Array:
    """``rule`` of each text, made part by part: a batch's texts and results are Arrow's, never all Python's."""
    parts = [pa.array([rule(x.as_py()) for x in texts.slice(k, PART)], kind) for k in range(0, len(texts), PART)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _protected(texts: pa.Array) -> pa.Array:
    def one(s: str | None) -> dict:
        text, pairs = (None, []) if s is None else protect_text(s)
        return {"text": text, "tokens": [{"name": n, "token": x} for n, x in pairs]}

    return by_part(texts, one, pa.struct([("text", pa.string()), ("tokens", pa.list_(pa.struct([("name", pa.string()), ("token", pa.string())])))]))


@F.arrow_udf(PROTECTED)
def protect(texts: pa.Array) -> pa.Array:
    return _protected(texts)


@F.arrow_udf(T.ArrayType(PROTECTED))
def protect_each(texts: pa.Array) -> pa.Array:
    """As ``protect``, of each of a row's texts; null stays null."""
    lengths = [n or 0 for n in texts.value_lengths().to_pylist()]
    found = pa.ListArray.from_arrays(pa.array([0, *accumulate(lengths)], pa.int32()), _protected(texts.flatten()))
    return pc.if_else(texts.is_valid(), found, pa.scalar(None, found.type)) if texts.null_count else found


@F.arrow_udf(T.ArrayType(T.StringType()))
def tokens_of(texts: pa.Array) -> pa.Array:
    return by_part(texts, lambda s: [] if s is None else [s[a:b] for a, b in spans(s)], pa.list_(pa.string()))


def restored(protected: str) -> Column:
    """The original text of a protected struct, placeholders in any case; a native fold."""
    pairs = F.col(f"{protected}.tokens")
    return F.aggregate(pairs, F.col(f"{protected}.text"), lambda acc, p: F.regexp_replace(acc, F.concat(F.lit("(?i)"), p["name"]), F.regexp_replace(p["token"], r"([\\$])", r"\\$1")))
