"""Quality rules by distribution divergence.

Every text is held against references of its language: the share of each character class, and the share of each of the
language's most common words. A reference is the sum over all documents of that language; words are told apart after
their edge punctuation is cut and A-Z is lower-cased. The distance is the Jensen-Shannon distance (base 2, 0 to 1).

Guards: a text with fewer than ``min_chars`` characters in words is not judged by its classes, one with fewer than
``min_words`` words not by its common words, and a language with fewer than ``min_docs`` documents is not judged at all:
short histograms are far from any reference by chance. Null texts have no words; a null language is a language of its
own. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices, texts

# The symbols and bounds that the base rules name.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 0.50

COMMON_WORDS = 64
MAX_CLASS_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.39
MIN_CHARS = 200
MIN_WORDS_JUDGED = 100
MIN_DOCS = 30

CLASSES = ("lower", "upper", "digit", "mark", "symbol", "other")
_EDGES = b"".join(bytes([c]) for c in range(0x21, 0x7F) if not chr(c).isalnum())
_TABLE = np.full(128, CLASSES.index("mark"), np.uint8)
_TABLE[list(range(97, 123))] = CLASSES.index("lower")
_TABLE[list(range(65, 91))] = CLASSES.index("upper")
_TABLE[list(range(48, 58))] = CLASSES.index("digit")
_TABLE[[ord(c) for c in SYMBOLS]] = CLASSES.index("symbol")
_NOT_SYMBOL = bytes(c for c in range(256) if chr(c) not in SYMBOLS)
_NOT_START = bytes(range(0x80, 0xC0))  # bytes inside a code point


def class_counts(raw: bytes) -> np.ndarray:
    """Counts of the character classes in words (UTF-8 without white space)."""
    data = np.frombuffer(raw, np.uint8)
    ascii_ = data[data < 128]
    counts = np.bincount(_TABLE[ascii_], minlength=len(CLASSES)).astype(np.int64)
    if len(ascii_) < len(data):
        for c, n in Counter(raw.translate(None, bytes(range(128))).decode("utf-8", "replace")).items():
            counts[CLASSES.index("upper" if c.isupper() else "lower" if c.isalpha() else "digit" if c.isdigit() else "other")] += n
    return counts


def common_form(word: bytes) -> bytes:
    return word.lower().strip(_EDGES)


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """Characters in words, symbols, repeated lines with a word, words in 3-word windows found twice or more."""
    raw = text.encode("utf-8", "surrogatepass")
    joined = b"".join(words)
    chars = len(joined.translate(None, _NOT_START))
    symbols = len(raw.translate(None, _NOT_SYMBOL))
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\n\r\x0b\x0c")]
    n = len(words)
    repeated = 0
    if n > 3:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
        if len(known) < n:  # else no window can come twice
            v = len(known)
            pair = ids[:-1] * v + ids[1:]
            _, pair = np.unique(pair, return_inverse=True)  # dense, so the next product cannot overflow
            _, at, count = np.unique(pair[:-1].astype(np.int64) * v + ids[2:], return_inverse=True, return_counts=True)
            hit = np.flatnonzero(count[at] > 1)
            if len(hit):
                covered = np.zeros(n, bool)
                for shift in range(3):
                    covered[hit + shift] = True
                repeated = int(covered.sum())
    return chars, symbols, len(lines) - len(set(lines)), repeated


def references(docs: DataFrame, common_words: int = COMMON_WORDS) -> DataFrame:
    """One row per language: n_docs, class shares, its most common words and their shares of all words.

    Tasks sum their own classes and words before anything is shuffled. Word counts of a language are spread over all
    tasks by word, and only each language's top words meet.
    """
    schema = "lang string, kind string, word binary, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            counts: Counter = Counter()
            for lang, text in zip(part.column("lang").to_pylist(), texts(part, "text"), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                counts[lang, "docs", b""] += 1
                for c, n in zip(CLASSES, class_counts(b"".join(words)).tolist(), strict=True):
                    counts[lang, "class", c.encode()] += n
                counts[lang, "words", b""] += len(words)
                for w, n in Counter(words).items():
                    counts[lang, "word", common_form(w)] += n
            rows = [[*k, n] for k, n in counts.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.string(), pa.string(), pa.binary(), pa.int64()], strict=True)], ["lang", "kind", "word", "n"])

    counts = docs.select("lang", "text").mapInArrow(run, schema).groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    top = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    words = counts.where("kind = 'word' and word != X''").withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= common_words)
    few = counts.where("kind != 'word'").unionByName(words.drop("rank"))
    return (
        few.groupBy("lang")
        .agg(
            F.max(F.when(F.col("kind") == "docs", F.col("n"))).alias("n_docs"),
            F.max(F.when(F.col("kind") == "words", F.col("n"))).alias("n_words"),
            F.collect_list(F.when(F.col("kind") == "class", F.struct("word", "n"))).alias("classes"),
            F.collect_list(F.when(F.col("kind") == "word", F.struct("word", "n"))).alias("words"),
        )
    )


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms of shares; two empty ones are the same."""
    p, q = p / max(p.sum(), 1e-300), q / max(q.sum(), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(x > 0, x * np.log2(x / m), 0).sum() for x in (p, q)]
    return float(np.sqrt(max(0.0, min(1.0, sum(parts) / 2))))


class Reference:
    def __init__(self, row) -> None:
        classes = {bytes(c.word).decode(): c.n for c in row.classes}
        self.classes = np.array([classes.get(c, 0) for c in CLASSES], float)
        self.words = {bytes(w.word): i for i, w in enumerate(row.words)}
        shares = np.array([w.n for w in row.words], float) / max(1, row.n_words or 0)
        self.shares = np.append(shares, max(0.0, 1 - shares.sum()))
        self.n_docs = row.n_docs or 0


FIELDS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, "
    "word_distance double, base_failed boolean, kept boolean"
)


def judge(
    docs: DataFrame,
    common_words: int = COMMON_WORDS,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS_JUDGED,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """All columns of ``docs``, and ``FIELDS`` (columns of those names are replaced).

    Languages are few (a reference holds ``common_words`` words), so their references go to the driver and to every
    task. Distances that a guard leaves out are null.
    """
    found = references(docs, common_words).collect()  # one row per language
    by_lang = {r.lang: Reference(r) for r in found}
    names = [f.split(" ")[0] for f in FIELDS.split(", ")]
    kept = [f for f in docs.schema.fields if f.name not in names]
    schema = T.StructType([*kept, *_fields()])

    def verdict(lang: str | None, text: str) -> tuple:
        words = text.encode("utf-8", "surrogatepass").split()
        n = len(words)
        chars, symbols, dup_lines, repeated = base_counts(text, words)
        ref = by_lang.get(lang)
        by_class = by_word = None
        if ref and ref.n_docs >= min_docs:
            if chars >= min_chars:
                by_class = distance(class_counts(b"".join(words)).astype(float), ref.classes)
            if n >= min_words:
                hist = np.zeros(len(ref.shares))
                for w, k in Counter(words).items():
                    hist[ref.words.get(common_form(w), -1)] += k
                by_word = distance(hist, ref.shares)
        failed = n < MIN_WORDS or repeated > MAX_REPEATED * n
        far = (by_class is not None and by_class > max_class_distance) or (by_word is not None and by_word > max_word_distance)
        return n, chars, symbols, dup_lines, repeated, by_class, by_word, failed, not failed and not far

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
        for part in slices(batches, "text"):
            rows = [verdict(lang, t) for lang, t in zip(part.column("lang").to_pylist(), texts(part, "text"), strict=True)]
            found = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *found], [f.name for f in schema.fields])

    return docs.drop(*names).mapInArrow(run, schema)


def _fields() -> list[T.StructField]:
    kinds = {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    return [T.StructField(n, kinds[k]) for n, k in (f.split(" ") for f in FIELDS.split(", "))]
