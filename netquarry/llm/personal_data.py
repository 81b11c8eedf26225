"""Personal data in whole texts, disguised or not, as spans of the source text.

Base spans come from plain patterns. The method then runs transducers over a text, each
of which keeps the source stretch of every character it writes: the first folds characters
(look-alikes of other scripts, wide forms, foreign digits, unusual spaces, nothing for
zero-width ones; compatibility forms such as mathematical letters become what they stand for), the others rewrite words (spelled digits and the dots between digits, then
``at`` and ``dot`` in brackets, then bare ones between the parts of an address). The same detectors read the result, and each find that
rests on a rewritten character is mapped back to the characters it came from.

Spans count code points, end exclusive. Kinds, in the order that breaks ties: email, ip,
card, phone. An added span never touches a base span of its kind.

Rows are independent: no shuffle, and a task holds one slice of texts. Detectors and transducers are
linear in a text's length: patterns are anchored at a sign or word and walk outwards from it without a
limit on blanks, labels or dots, and never give back what they took.

Defined cases: null text counts as empty (no spans, the digest of the empty string);
repeated rows are scanned alike; texts of any length are scanned whole; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, kind, end

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a match can start only where a run of digits does: from inside it, the same rest would have matched
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def find(text: str) -> list[Span]:
    """Spans of the plain patterns, sorted."""
    found: list[Span] = []
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, 0, domain.end()))
        low = domain.end() if domain else at + 1
        at = text.find("@", low)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m.group().replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


#: Letters of other scripts that look like Latin ones.
LOOK_ALIKES = dict(zip(
    "АВЕКМНОРСТУХЅІЈаеорсухѕіјһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοναιυρεηκτχγωѵӏҮүԌօոսհցզɑɡɩᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢᎪᎬᎻᎷᎢᏔᏃᏟ",
    "ABEKMHOPCTYXSIJaeopcyxsijhdqwABEZHIKMNOPTYXovaiupenktxywvlYyGonuhgqagiabcdefghijklmnoprstuvwyzAEHMTWZC",
    strict=True,
))
_DASHES, _DOTS, _NOTHING = "‐‑‒–—−", "․。｡", "​‌‍⁠﻿­"


def _folds() -> dict[str, str]:
    plain = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x250, 0x1FBFA))
    table = {c: n for c, n in plain if n != c and n.isascii() and n.isprintable()} | LOOK_ALIKES  # wide, mathematical and circled forms
    table |= {chr(c): str(unicodedata.digit(chr(c))) for c in range(0x80, 0x1FBFA) if unicodedata.category(chr(c)) == "Nd"}
    table |= dict.fromkeys(_DASHES, "-") | dict.fromkeys(_DOTS, ".") | dict.fromkeys(_NOTHING, "")
    return table | {chr(c): " " for c in range(0x80, 0x3001) if unicodedata.category(chr(c)) == "Zs"}


FOLDS = _folds()
_UNUSUAL = re.compile("[^\\x00-\\x9f\\xa1-\\xac\\xae-\\u024f]")  # all that FOLDS holds, and more

#: Digit words of the corpus's languages, 0 to 9 (o and oh also stand for 0).
DIGIT_WORDS = {
    "en": ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"],
    "de": ["null", "eins", "zwei", "drei", "vier", "fünf", "sechs", "sieben", "acht", "neun"],
    "fr": ["zéro", "un", "deux", "trois", "quatre", "cinq", "six", "sept", "huit", "neuf"],
    "es": ["cero", "uno", "dos", "tres", "cuatro", "cinco", "seis", "siete", "ocho", "nueve"],
}
_VALUE = {w: str(i) for words in DIGIT_WORDS.values() for i, w in enumerate(words)} | {"oh": "0"}
_POINT = "dot|point|punkt|punto"
_NUMBER = "|".join(sorted(_VALUE, key=len, reverse=True))
_TOKEN = re.compile(rf"(?i:(?:(double|triple)[ -]++)?(?:({_NUMBER})|([0-9]+))|(plus)|({_POINT})|(dash|hyphen))(?![^\W_])")
_TIMES = {"double": 2, "triple": 3}
_SPELLED = re.compile(
    rf"(?<![^\W_])(?:(?i:plus)[ ,-]++)?(?:(?i:double|triple)[ -]++)?(?i:{_NUMBER}|[0-9]+)(?![^\W_])"
    rf"(?:[ ,.-]++(?:(?i:double|triple)[ -]++)?(?i:{_NUMBER}|{_POINT}|dash|hyphen|[0-9]+)(?![^\W_])){{3,}}+"
)
_BRACKET = re.compile(rf"[(\[{{<]\s*+(?:((?i:at|@))|(?i:{_POINT}|\.))\s*+[)\]}}>]\s*+")
_ANCHOR = re.compile(r"(?<=\s)[aA][tT](?=\s)|@")
_BLANK = re.compile(r"\s*+")
_HOST = re.compile(rf"[A-Za-z0-9-]++(?:(?:\.|\s++(?i:{_POINT})\s++)[A-Za-z0-9-]++(?![^\W_]))++")
_HOST_DOT = re.compile(rf"\.|\s++(?i:({_POINT}))\s++")
#: Local parts that no plain word gives: a letter first, and a digit or a sign other than a hyphen inside.
_MADE = re.compile(r"[A-Za-z](?=.*[._%+0-9]).*[A-Za-z0-9]", re.S)
#: Last parts of addresses that are no English words; after a bare "at", "this point in" is prose.
_ENDS = frozenset("com org net edu gov info io eu uk fr de es ch ca lu mx ar co".split())


def _lower(text: str) -> str:
    """Lower case, with the two letters that patterns take for i and s in any case."""
    return text.lower().replace("ı", "i").replace("ſ", "s")


Edit = tuple[int, int, str]


class Rewritten:
    """A text after some edits, with the source stretch of each of its characters."""

    def __init__(self, text: str, edits: list[Edit]):
        self.at, self.source, self.edited, pieces, n, last = [0], [0], [False], [], 0, 0
        self.ends = [0]
        for start, end, new in edits:
            for piece, a, b, changed in ((text[last:start], last, start, False), (new, start, end, True)):
                if piece:
                    self.at.append(n)
                    self.source.append(a)
                    self.ends.append(b)
                    self.edited.append(changed)
                    pieces.append(piece)
                    n += len(piece)
            last = end
        self.at.append(n)
        self.source.append(last)
        self.ends.append(len(text))
        self.edited.append(False)
        self.text = "".join(pieces) + text[last:]

    def stretch(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source start and end of a stretch of the new text, and if any of it was rewritten."""
        i, j = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        a = self.source[i] if self.edited[i] else self.source[i] + start - self.at[i]
        b = self.ends[j] if self.edited[j] else self.source[j] + end - self.at[j]
        gaps = any(self.ends[k] != self.source[k + 1] for k in range(i, j))  # characters written as nothing
        return a, b, gaps or any(self.edited[i : j + 1])


def _written(times: str | None, number: str | None, digits: str | None, plus: str | None, point: str | None) -> str:
    """What a token of a spelled run stands for; "double" and "triple" repeat one digit."""
    if not number and not digits:
        return "+" if plus else "." if point else "-"
    value = _VALUE.get(_lower(number), "") if number else digits
    return value * _TIMES[_lower(times)] if times and len(value) == 1 else value


def _spelled_edits(text: str) -> list[Edit]:
    """Runs of digits with a spelled digit or point; with fewer than three, plain digits stay as far apart as they are."""
    edits: list[Edit] = []
    for m in _SPELLED.finditer(text):
        tokens = list(_TOKEN.finditer(text, m.start(), m.end()))
        while tokens and (tokens[-1][5] or tokens[-1][6]):
            tokens.pop()  # a point after the last digit may be that of an address
        if not any(t[2] or t[5] for t in tokens):
            continue
        close = sum(1 for t in tokens if t[2]) >= 3
        for k, t in enumerate(tokens):
            new = _written(*t.groups()[:5])
            after = tokens[k + 1] if k + 1 < len(tokens) else None
            if not after or not close and t[3] and after[3]:
                edits.append((t.start(), t.end(), new))
            else:
                edits.append((t.start(), after.start(), new))
    return [e for e in edits if text[e[0] : e[1]] != e[2]]


def _before_blanks(text: str, at: int, low: int) -> int:
    while at > low and text[at - 1].isspace():
        at -= 1
    return at


def _bracket_edits(text: str) -> list[Edit]:
    """At and dot in brackets, with the blanks around them."""
    edits: list[Edit] = []
    for m in _BRACKET.finditer(text):
        edits.append((_before_blanks(text, m.start(), edits[-1][1] if edits else 0), m.end(), "@" if m[1] else "."))
    return edits


def _bare_edits(text: str, before: Rewritten | None) -> list[Edit]:
    """Bare at and dot of addresses. ``before``: how the text came from brackets.

    After a bare "at", an address needs a disguised dot, or a local part that no plain word
    gives ("meet at example.com" is prose); "point" alone also needs a last part that is no word.
    """
    edits: list[Edit] = []
    low = 0
    for m in _ANCHOR.finditer(text):
        bare = m.group() != "@"
        left = _before_blanks(text, m.start(), low) if bare else m.start()
        right = _BLANK.match(text, m.end()).end() if bare else m.end()
        start = left
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        low = m.end()
        host = _HOST.match(text, right) if start < left else None
        if not host:
            continue
        dots = list(_HOST_DOT.finditer(text, host.start(), host.end()))
        if bare:
            sure = any(d[1].lower() != "point" if d[1] else before and before.stretch(d.start(), d.end())[2] for d in dots)
            pointed = any(d[1] for d in dots) and text[dots[-1].end() : host.end()].lower() in _ENDS
            if not sure and not pointed and not _MADE.fullmatch(text[start:left]):
                continue
            edits.append((left, right, "@"))
        edits += [(d.start(), d.end(), ".") for d in dots if d[1]]
    return edits


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows."""
    folds = [(m.start(), m.end(), FOLDS[m.group()]) for m in _UNUSUAL.finditer(text) if m.group() in FOLDS]
    layers, bracketed = [], None
    for edits_of in (lambda _: folds, _spelled_edits, _bracket_edits, lambda t: _bare_edits(t, bracketed)):
        last = layers[-1].text if layers else text
        edits = edits_of(last)
        if edits:
            layers.append(Rewritten(last, edits))
            bracketed = layers[-1] if edits_of is _bracket_edits else None
    if not layers:
        return []
    added = []
    for start, kind, end in find(layers[-1].text):
        changed = False
        for layer in reversed(layers):
            start, end, also = layer.stretch(start, end)
            changed |= also
        if changed and not any(k == kind and a < end and start < b for a, k, b in base):
            added.append((start, kind, end))
    return added


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        counts, digests, spans = [[], [], [], []], [], []
        for text in part.column(1).to_pylist():
            base = find(text)
            for k in range(4):
                counts[k].append(sum(1 for s in base if s[1] == k))
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            spans.append(_joined(sorted(base + disguised(text, base))))
        yield pa.RecordBatch.from_arrays(
            [part.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())],
            names=[x.split()[0] for x in _SCHEMA.split(", ")],
        )


def personal_data(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Counts, digest and spans of every row of ``docs``."""
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return given.mapInArrow(_scan, _SCHEMA)
