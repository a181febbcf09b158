"""Personal data, also behind disguises, as spans of the source text.

Two passes. The first looks for identifiers in the text as it is. The second runs transducers that rewrite disguises —
look-alike letters and digits, spelled digits, ``[at]`` and ``(dot)`` — and remember for every rewritten piece where it
came from; identifiers found in the normalised text are mapped back to the characters they stand for. A span of the
second pass counts if it contains something rewritten and touches no span of the first pass, or only one of its kind that
is a part of it.

Texts without any sign of a disguise skip the second pass; others are normalised line by line, as no identifier crosses
a line.

Spans are (kind, start, end) in code points, end exclusive. Null texts count as empty and have none.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices, texts

KINDS = ("email", "ip", "card", "phone")
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}

# An e-mail address is found from its @: the part before it reaches as far left as its characters allow.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where no digit precedes it: further right in a run of digits it fails as well.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def identifiers(text: str) -> list[tuple[str, int, int]]:
    """Spans of a text as it is, by kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


# Look-alikes, each of one code point for one code point, so offsets do not move. Full-width forms follow from a rule.
_GREEK_CYRILLIC = {
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ɡ": "g", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "К": "K",
    "М": "M", "О": "O", "Р": "P", "Т": "T", "Х": "X",
}
HOMOGLYPHS = {ord(k): v for k, v in _GREEK_CYRILLIC.items()}
HOMOGLYPHS |= {0xFF00 + i: chr(0x20 + i) for i in range(1, 0x5F)}
HOMOGLYPHS |= {base + d: str(d) for base in (0x0660, 0x06F0, 0x0966, 0x2080, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
HOMOGLYPHS |= {ord("．"): ".", ord("。"): ".", ord("‐"): "-", ord("‑"): "-", ord("–"): "-", 0xA0: " ", 0x2009: " ", 0x202F: " "}
_ALIKE = re.compile("[" + "".join(map(re.escape, map(chr, HOMOGLYPHS))) + "]")

DIGIT_WORDS = {w: str(d) for d, w in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_NUMBER = "(?:" + "|".join(DIGIT_WORDS) + "|double|triple)"
# Spelled digits count in runs of four or more, so that a number word in prose stays what it is.
_SPELLED = re.compile(rf"\b{_NUMBER}(?:(?:[ ,.-]|, ){_NUMBER}\b|(?:[ -])?[0-9]+\b|[ -]){{3,}}", re.I)
_NUMBER_WORD = re.compile(rf"\b{_NUMBER}\b", re.I)
# A sign of an address is plain, in brackets or spelled out, each of them as it comes.
_OPEN, _CLOSE = r"[ ]?[\[({<][ ]?", r"[ ]?[\])}>][ ]?"
_BRACKET = re.compile(rf"{_OPEN}(at|dot|punkt|point|punto|arroba|@|\.){_CLOSE}", re.I)
_AT_SIGN = re.compile(rf"@| at |{_OPEN}(?:at|arroba|@){_CLOSE}", re.I)
_DOT = rf"(?:\.| dot |{_OPEN}(?:dot|punkt|point|punto|\.){_CLOSE})"
_HOST = re.compile(rf"[A-Z0-9-]{{1,63}}(?:{_DOT}[A-Z0-9-]{{1,63}})*{_DOT}[A-Z]{{2,63}}\b", re.I)
_SAID_DOT = re.compile(" dot ", re.I)
# What must stand in a lower-cased text that has an address with a spelled sign.
_SAID = re.compile(r" at [a-z0-9-]{1,63}(?:\.[a-z0-9-]| dot |[ ]?[\[({<])|(?:@|[\])}>])[ ]?[a-z0-9-][^\n@]* dot ")
# ``look at the dot product``: an article is no host, unless a well-known name follows.
_ARTICLE = re.compile(r"(?:the|an?) dot (?!(?:com|org|net|edu|gov|info|biz|dev|io|co|[a-z]{2})\b)", re.I)
_AT = {"at", "@", "arroba"}


def _spoken(line: str) -> Iterator[tuple[int, int, str]]:
    """Spelled signs of the addresses in a line, and the sign that each stands for."""
    done = 0
    for sign in _AT_SIGN.finditer(line):
        start = sign.start()
        while start > done and line[start - 1] in _LOCAL:
            start -= 1
        host = _HOST.match(line, sign.end()) if any(c.isalnum() for c in line[start : sign.start()]) else None
        said = sign.group().lower() == " at "
        if host is None or said and _ARTICLE.match(line, sign.end()):
            continue
        if said:
            yield sign.start(), sign.end(), "@"
        for dot in _SAID_DOT.finditer(line, host.start(), host.end()):
            yield dot.start(), dot.end(), "."
        done = host.end()


class Rewrites:
    """Pieces of a normalised text and the source characters each stands for."""

    def __init__(self, source: str):
        self.source = source
        self.edits: list[tuple[int, int, str]] = []

    def add(self, start: int, end: int, new: str) -> None:
        self.edits.append((start, end, new))

    def build(self) -> str:
        out, at, place = [], 0, 0
        self.starts, self.pieces = [], []  # normalised start of each piece; (source start, source end, rewritten)
        for start, end, new in sorted(self.edits):
            if start < at:
                continue  # an earlier rewrite has these characters
            for a, b, text, changed in ((at, start, self.source[at:start], False), (start, end, new, True)):
                if text or changed:
                    self.starts.append(place)
                    self.pieces.append((a, b, changed))
                    out.append(text)
                    place += len(text)
            at = end
        self.starts.append(place)
        self.pieces.append((at, len(self.source), False))
        out.append(self.source[at:])
        return "".join(out)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of a normalised span, and whether anything in it was rewritten."""
        i = bisect.bisect_right(self.starts, start) - 1
        j = bisect.bisect_left(self.starts, end) - 1
        (a, b, first), (c, d, last) = self.pieces[i], self.pieces[j]
        lo = a if first else a + start - self.starts[i]
        hi = d if last else c + end - self.starts[j]
        return lo, hi, any(p[2] for p in self.pieces[i : j + 1])


def _spell(piece: Rewrites, text: str, offset: int) -> None:
    """Rewrite the number words of a run; separators between single digits go."""
    words = [*_NUMBER_WORD.finditer(text)]
    times = 1
    for k, m in enumerate(words):
        word = m.group().lower()
        if word in ("double", "triple"):
            times = 2 if word == "double" else 3
            end = words[k + 1].start() if k + 1 < len(words) else m.end()
            piece.add(offset + m.start(), offset + end, "")
            continue
        end = m.end()
        if k + 1 < len(words) and not text[end : words[k + 1].start()].strip(" ,.-"):
            end = words[k + 1].start()
        piece.add(offset + m.start(), offset + end, DIGIT_WORDS[word] * times)
        times = 1


def disguised(text: str) -> list[tuple[str, int, int]]:
    """Spans that appear only after normalising."""
    alike = not text.isascii() and _ALIKE.search(text) is not None
    flat = text.translate(HOMOGLYPHS) if alike else text  # disguises are looked for behind look-alikes, too
    low = flat.lower()
    bracket = any(c in flat for c in "[({<") and _BRACKET.search(flat) is not None
    spoken = (" at " in low or " dot " in low) and _SAID.search(low) is not None
    spelled = any(w in low for w in DIGIT_WORDS) and _SPELLED.search(flat) is not None
    if not (alike or bracket or spoken or spelled):
        return []
    out, at = [], 0
    for line in flat.split("\n"):  # no identifier crosses a line
        source = text[at : at + len(line)]
        rewrites = Rewrites(line)
        if bracket:
            for m in _BRACKET.finditer(line):
                rewrites.add(m.start(), m.end(), "@" if m.group(1).lower() in _AT else ".")
        if spoken:
            for edit in _spoken(line):
                rewrites.add(*edit)
        if spelled:
            for m in _SPELLED.finditer(line):
                _spell(rewrites, m.group(), m.start())
        if rewrites.edits or source != line:
            for kind, a, b in identifiers(rewrites.build()):
                lo, hi, changed = rewrites.back(a, b)
                if changed or source[lo:hi] != line[lo:hi]:
                    out.append((kind, at + lo, at + hi))
        at += len(line) + 1
    return out


def spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of the text as it is, and all spans; both by kind as listed, then start."""
    base = identifiers(text)
    more = disguised(text)
    if not more:
        return base, base
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]

    def new(kind: str, a: int, b: int) -> bool:
        i = bisect.bisect_left(starts, b)
        touched = [s for s in taken[max(0, i - 16) : i] if s[1] > a]
        return not touched or (len(touched) == 1 and a <= touched[0][0] and touched[0][1] <= b and (kind, *touched[0]) in whole and b - a > touched[0][1] - touched[0][0])

    whole = set(base)
    added = [s for s in more if new(*s)]
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


_SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_ARROW_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _list(found: list[list[tuple[str, int, int]]]) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in row] for row in found], _ARROW_SPAN)


def detect(docs: DataFrame, column: str = "text") -> DataFrame:
    """All columns but the text, and ``base`` and ``spans``: arrays of (kind, start, end). Columns of those names are replaced."""
    kept = [f for f in docs.schema.fields if f.name not in (column, "base", "spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            base, every = zip(*(spans(t) for t in texts(part, column)), strict=True)
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), _list(base), _list(every)], [*(f.name for f in kept), "base", "spans"])

    return docs.drop("base", "spans").mapInArrow(run, T.StructType([*kept, T.StructField("base", _SPAN), T.StructField("spans", _SPAN)]))


def masked(text: str) -> str:
    """The text with every span replaced by its mask; of spans that overlap, the one that starts first and is longest."""
    out, at = [], 0
    for kind, a, b in sorted(spans(text)[1], key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], MASKS[kind]]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, column: str = "text") -> DataFrame:
    """All columns, with personal data masked in the text. Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            new = pa.array([None if t is None else masked(t) for t in part.column(column).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if n == column else part.column(n) for n in part.schema.names], part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def written(column: str):
    """Spans of an array column as ``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
