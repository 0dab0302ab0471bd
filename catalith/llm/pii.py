"""Personal data with offset-preserving deobfuscation.

Base spans come from fixed patterns on the text itself. Disguised identifiers
come from a chain of transducers: each rewrites pieces of a character stream
(homoglyphs and width variants to ASCII, invisible characters to nothing,
spelled digits to digits, disguised "at" and "dot" to @ and .) while every
output character keeps the source span it came from. Identifiers found in the
normalised stream that cover at least one rewritten character are mapped back
to source offsets; one inside a base span is left out. Base spans stay as they
are, also where a disguised identifier reaches beyond one.

The scanners are linear in the text, so very long texts are fine. Null texts
count as empty; ``redact`` leaves them null. Repeated rows are looked at each for
itself, other columns stay as they are, and no rows give no rows. Offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")

Span = tuple[str, int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_LONG_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield "email", start, done
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and not overlapping within a kind."""
    out = list(_emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    if _LONG_CARD.search(text):
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = re.sub("[ -]", "", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# --- transducers -----------------------------------------------------------

# Letters of other scripts that look like ASCII letters.
_LOOKALIKES = dict(
    zip(
        "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρ",
        "ABESIJKMHOPCTYXaesijopcyxdqw" "ABEZHIKMNOPTYXovp",
        strict=True,
    )
)
_INVISIBLE = "­​‌‍⁠﻿"


def _glyphs() -> dict[str, str]:
    out = dict(_LOOKALIKES)
    out |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full width
    for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
        out |= {chr(zero + i): str(i) for i in range(10)}
    for first in (0x1D400, 0x1D5A0, 0x1D5D4, 0x1D670):  # mathematical alphabets
        out |= {chr(first + i): chr((65 if i < 26 else 71) + i) for i in range(52)}
    out |= {"﹫": "@", "․": ".", "。": ".", "｡": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " "}
    return out | {c: "" for c in _INVISIBLE}


_GLYPHS = _glyphs()
_GLYPH = re.compile("[" + "".join(map(re.escape, _GLYPHS)) + "]")
#: What is neither ASCII nor a letter of Latin-1: no other text can have a glyph to rewrite.
_FOREIGN = re.compile("[^\x00-\x7f\xa1-\xac\xae-\xff]")


def _has_glyph(text: str) -> bool:
    return not text.isascii() and bool(_FOREIGN.search(text)) and bool(_GLYPH.search(text))

# Names of the digits from zero on in English, German, French and Spanish.
_NAMES = (
    "zero oh null zéro cero",
    "one eins un uno",
    "two zwei zwo deux dos",
    "three drei trois tres",
    "four vier quatre cuatro",
    "five fünf cinq cinco",
    "six sechs seis",
    "seven sieben sept siete",
    "eight acht huit ocho",
    "nine neun neuf nueve",
)
_NUMBERS = {name: str(n) for n, names in enumerate(_NAMES) for name in names.split()}
_POINTS = frozenset("dot point punkt punto".split())
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_NAMED = "(?:" + "|".join(sorted(_NUMBERS, key=len, reverse=True)) + ")"
_POINT = "(?:" + "|".join(sorted(_POINTS)) + ")"
_GAP = "[ ,-]{1,2}"
_SPELLED = re.compile(
    rf"(?i)(?:(?<![{_LETTER}])(?:plus|\+){_GAP}?)?(?<![{_LETTER}0-9])(?:{_NAMED}|[0-9]++)(?![{_LETTER}])"
    rf"(?:{_GAP}(?:{_NAMED}|{_POINT}|[0-9]++)(?![{_LETTER}]))+"
)
_DIGIT_WORD = re.compile(rf"(?i)plus|\+|{_NAMED}|{_POINT}|[0-9]+")


def _has_spelled(text: str) -> bool:
    """At least three names of digits; a cheap test before the pattern."""
    words = text.lower().replace(",", " ").replace("-", " ").split()
    return not _NUMBERS.keys().isdisjoint(words) and sum(w in _NUMBERS for w in words) >= 3


#: Digits with letters that look like them, and long digit groups with other separators.
_ALIKE = {"O": "0", "o": "0", "l": "1", "I": "1"}
_MIXED = re.compile(rf"(?<![{_LETTER}0-9])\+?[0-9OolI](?:[ ().-]{{0,2}}[0-9OolI]){{6,}}+(?![{_LETTER}])")
_MIXED_HINT = re.compile(r"[0-9][OolI]|[OolI][0-9]")
_GROUPS = re.compile(r"(?<![0-9._/])[0-9]{4}(?:[._/][0-9]{4}){2}[._/][0-9]{2,7}(?![0-9._/])")

_AT_MARK = r"\s{0,2}[\[({<]\s{0,2}(?:at|@)\s{0,2}[\])}>]\s{0,2}"
_DOT_MARK = r"\s{0,2}[\[({<]\s{0,2}(?:dot|punkt|point|\.)\s{0,2}[\])}>]\s{0,2}"
_CODED = "&#64;|&#x40;|&commat;|%40", "&#46;|&#x2e;|&period;"
_SPACED = r"(?<=[A-Za-z0-9])[ ]{1,2}@[ ]{1,2}(?=[A-Za-z0-9-]{1,63}(?:\.|[ ]\.[ ])[A-Za-z])"
_MARK = re.compile(rf"(?i)(?P<at>{_AT_MARK}|{_CODED[0]}|{_SPACED})|(?P<dot>{_DOT_MARK}|{_CODED[1]})")
_MARK_HINT = re.compile(rf"(?i)[\[({{<]\s{{0,2}}(?:at|dot|punkt|point|@|\.)\s{{0,2}}[\])}}>]|{_CODED[0]}|{_CODED[1]}| @ ")
#: Bare words: one "at" and then at least one "dot", with a top-level domain last.
_BARE = re.compile(
    r"(?i)(?<![A-Za-z0-9._%+-])[a-z0-9_%+]{1,64}(?:(?:\.|[ _-]dot[ _-])[a-z0-9_%+]{1,64}){0,4}(?P<at>[ _-]at[ _-]|@)"
    r"[a-z0-9]{1,63}(?:(?:\.|[ _-]dot[ _-])[a-z0-9]{1,63}){0,4}[ _-]dot[ _-][a-z]{2,24}(?![A-Za-z0-9])"
)
_BARE_DOT = re.compile(r"(?i)[ _-]dot[ _-]")
_BARE_HINT = re.compile(r"(?i)[ _-]dot[ _-]|[0-9](?: \.|\. )[ ]?[0-9]")
_BARE_IP = re.compile(r"(?i)(?<![0-9.])[0-9]{1,3}(?:(?: dot | \. | ?\. ?)[0-9]{1,3}){3}(?![0-9.])")
_IP_POINT = re.compile(r"(?i) dot | ?\. ?")

#: A normalised character with the source span that it stands for.
Stream = tuple[str, list[int], list[int], bytearray]


def _start(text: str) -> Stream:
    return text, list(range(len(text))), list(range(1, len(text) + 1)), bytearray(len(text))


def _rewrite(stream: Stream, edits: list[tuple[int, int, str]]) -> Stream:
    """Apply (start, end, new text) edits, in order and not overlapping."""
    text, begin, end, new = stream
    if not edits:
        return stream
    out, b, e, n, at = [], [], [], bytearray(), 0
    for i, j, to in edits:
        out += [text[at:i], to]
        b += begin[at:i] + [begin[i]] * len(to)
        e += end[at:i] + [end[j - 1]] * len(to)
        n += new[at:i] + b"\x01" * len(to)
        at = j
    out.append(text[at:])
    return "".join(out), b + begin[at:], e + end[at:], n + new[at:]


def _glyph_edits(text: str) -> list[tuple[int, int, str]]:
    """Invisible characters go with the character before them, which counts as rewritten."""
    out: list[tuple[int, int, str]] = []
    for m in _GLYPH.finditer(text):
        i, to = m.start(), _GLYPHS[m[0]]
        if to:
            out.append((i, i + 1, to))
        elif out and out[-1][1] == i:
            out[-1] = (out[-1][0], i + 1, out[-1][2])
        elif i:
            out.append((i - 1, i + 1, text[i - 1]))
        else:
            out.append((0, 1, ""))
    return out


def _digit_edits(text: str) -> list[tuple[int, int, str]]:
    """Runs of spelled digits: at least seven digits of which three are spelled, or four parts of an address."""
    out = []
    for m in _SPELLED.finditer(text):
        items = [(t.start() + m.start(), t.end() + m.start(), t[0].lower()) for t in _DIGIT_WORD.finditer(m[0])]
        plain = "".join(_NUMBERS.get(w, w) for _, _, w in items if w not in _POINTS and w not in ("plus", "+"))
        named, dots = sum(w in _NUMBERS for _, _, w in items), sum(w in _POINTS for _, _, w in items)
        if named < 3 or not (len(plain) >= 7 or dots == 3 and len(plain) >= 4):
            continue
        for k, (i, j, w) in enumerate(items):
            stop = items[k + 1][0] if k + 1 < len(items) else j  # the gap goes with the digit before it
            out.append((i, stop, "." if w in _POINTS else "+" if w in ("plus", "+") else _NUMBERS.get(w, w)))
    return out


def _alike_edits(text: str) -> list[tuple[int, int, str]]:
    """O, l and I among mostly digits; dots and slashes between groups of four digits."""
    out = []
    for m in _MIXED.finditer(text):
        letters = [k for k, c in enumerate(m[0]) if c in _ALIKE]
        if letters and sum(c.isdigit() for c in m[0]) >= 2 * len(letters):
            out += [(m.start() + k, m.start() + k + 1, _ALIKE[m[0][k]]) for k in letters]
    for m in _GROUPS.finditer(text):
        out += [(m.start() + k, m.start() + k + 1, "-") for k, c in enumerate(m[0]) if not c.isdigit()]
    return sorted(set(out))


def _spelled_phones(text: str) -> list[Span]:
    """Ten to fifteen digits that are all spelled, without a plus sign before them."""
    out: list[Span] = []
    for m in _SPELLED.finditer(text):
        words = [t[0].lower() for t in _DIGIT_WORD.finditer(m[0])]
        if 10 <= len(words) <= 15 and all(w in _NUMBERS for w in words):
            out.append(("phone", *m.span()))
    return out


def _mark_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _MARK.finditer(text):
        out.append((*m.span(), "@" if m["at"] else "."))
    return out


def _bare_edits(text: str) -> list[tuple[int, int, str]]:
    out = []
    for m in _BARE_IP.finditer(text):
        out += [(m.start() + d.start(), m.start() + d.end(), ".") for d in _IP_POINT.finditer(m[0])]
    for m in _BARE.finditer(text):
        if m["at"] != "@":
            out.append((*m.span("at"), "@"))
        out += [(m.start() + d.start(), m.start() + d.end(), ".") for d in _BARE_DOT.finditer(m[0])]
    return sorted(set(out))


def normalise(text: str) -> Stream | None:
    """The normalised stream, or None where no transducer has work."""
    stream, worked = _start(text), False
    for hint, edits in (
        (_has_glyph, _glyph_edits),
        (_has_spelled, _digit_edits),
        (_MIXED_HINT.search, _alike_edits),
        (_GROUPS.search, _alike_edits),
        (_MARK_HINT.search, _mark_edits),
        (_BARE_HINT.search, _bare_edits),
    ):
        if hint(stream[0]) and (found := edits(stream[0])):
            stream, worked = _rewrite(stream, found), True
    return stream if worked else None


def _needs_work(text: str) -> bool:
    return bool(
        _has_glyph(text)
        or _MARK_HINT.search(text)
        or _has_spelled(text)
        or _MIXED_HINT.search(text)
        or _GROUPS.search(text)
        or _BARE_HINT.search(text)
    )


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that only the normalised text shows, in source offsets."""
    if not _needs_work(text) or (stream := normalise(text)) is None:
        return []
    plain, begin, end, new = stream
    out: list[Span] = []
    for kind, i, j in base_spans(plain):
        if not any(new[i:j]):
            continue
        a, b = begin[i], max(end[i:j])
        if any(x <= a and b <= y for _, x, y in base):
            continue
        if kind == "email" and not re.search(r"\.[A-Za-z]{2,24}$", plain[i:j]):
            continue
        out.append((kind, a, b))
    for span in _spelled_phones(text):
        if not any(x < span[2] and span[1] < y for _, x, y in base + out):
            out.append(span)
    return in_order(out)


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, added spans) of a text."""
    text = text or ""
    base = base_spans(text)
    return base, added_spans(text, base)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each stretch of spans replaced by its first span's kind in brackets."""
    out, at = [], 0
    for kind, i, j in spans:
        if i >= at:
            out += [text[at:i], f"[{kind}]"]
        at = max(at, j)
    return "".join(out) + text[at:]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{i}:{j}" for k, i, j in spans)


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``pii``: an array of (kind, start, end, disguised); a column of that name is replaced."""
    docs = docs.drop("pii")
    found = T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("disguised", "boolean")
    schema = T.StructType([*docs.schema.fields, T.StructField("pii", T.ArrayType(found))])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("disguised", pa.bool_())]))
        for batch in batches:
            rows = []
            for t in batch.column(names.index(text)):
                base, more = find(t.as_py())
                known = set(base)
                rows.append([{"kind": k, "start": i, "end": j, "disguised": (k, i, j) not in known} for k, i, j in in_order(base + more)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*names, "pii"])

    return docs.mapInArrow(run, schema)


def redact(docs: DataFrame) -> DataFrame:
    """Documents with personal data in ``text`` masked and ``n_chars`` counted anew."""
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts = list(batch.columns), []
            for t in batch.column(names.index("text")):
                t = t.as_py()
                texts.append(None if t is None else mask(t, in_order([s for part in find(t) for s in part])))
            columns[names.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in names:
                columns[names.index("n_chars")] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, schema)


def op4_pii(docs: DataFrame) -> DataFrame:
    """One row a document; the n_ columns count base spans, the m_ columns all spans."""
    counts = [f"n_{k}" for k in KINDS] + [f"m_{k}" for k in KINDS]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_sha256 string, spans string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(len(counts) + 2)]
            for t in batch.column(1):
                base, more = find(t.as_py())
                every = in_order(base + more)
                row = [sum(s[0] == k for s in spans) for spans in (base, every) for k in KINDS]
                for c, v in zip(out, [*row, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)], strict=True):
                    c.append(v)
            kinds = [pa.int64()] * len(counts) + [pa.string()] * 2
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *arrays], ["doc_id", *counts, "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
