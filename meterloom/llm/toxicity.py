"""Toxicity by a weighted lexicon.

Texts are folded (lower case, look-alike letters and digit substitutions to plain letters) and matched by Aho-Corasick.
Entries are whole words and word stems; a hit must begin at a word, and end at one unless it is a stem. Hits inside an
exception phrase do not count. The weights of the hits are summed, divided by a power of the number of words, and turned
into a probability by a logistic curve.

Lexicon, weights, exceptions and curve are learned from labelled rows: document frequencies of words and stems in toxic
and clean rows give log-odds, and two-word phrases around hits that are usual in clean rows become exceptions. Learning
takes at most ``SAMPLE_ROWS`` labelled rows (those with the lowest hash of their id), of which equal texts count once;
everything else covers all rows.

Without toxic or without clean labelled rows the lexicon is empty and every score is the share of toxic rows (0 without
rows). Null texts count as empty. A null label is no label; of several labels of a document the highest counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import doc_bucket, slices, texts
from .pii import HOMOGLYPHS

SAMPLE_ROWS = 20_000
STEMS = (4, 5, 6, 7)
LEAST_TOXIC_ROWS = 4
LEAST_TOXIC_SHARE = 0.01
LEAST_WEIGHT = 2.0
LEAST_EXCEPTION_ROWS = 3
POWERS = (0.0, 0.25, 0.5, 0.75, 1.0)

_WORD = re.compile(r"[^\W_]+")
_SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
_FOLD = {k: v.lower() for k, v in HOMOGLYPHS.items()}
_FOLD |= {k: _SUBSTITUTES.get(v, v) for k, v in _FOLD.items()} | {ord(k): v for k, v in _SUBSTITUTES.items()}


def fold(text: str) -> str:
    """Code point for code point, so places stay those of the lower-cased text."""
    return text.lower().translate(_FOLD)


@dataclass
class Model:
    """Entries (a stem ends with ``*``) with weights, exception phrases, and the curve."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    power: float = 0.5
    slope: float = 0.0
    offset: float = -math.inf

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        found = ahocorasick.Automaton()
        by_text: dict[str, list[tuple[bool, float]]] = {}
        for entry, weight in self.weights.items():
            by_text.setdefault(entry.rstrip("*"), []).append((entry.endswith("*"), weight))
        for text, kinds in by_text.items():
            found.add_word(text, (len(text), kinds))
        found.make_automaton()
        return found


def hits(automaton: ahocorasick.Automaton, text: str) -> list[tuple[int, int, float]]:
    """Start of the word, end of the word and weight of every hit in a folded text, one (the heaviest) per word."""
    best: dict[int, tuple[int, int, float]] = {}
    n = len(text)
    for last, (size, kinds) in automaton.iter(text):
        start, end = last + 1 - size, last + 1
        if start and text[start - 1].isalnum():
            continue
        whole = end == n or not text[end].isalnum()
        for stem, weight in kinds:
            if (stem or whole) and (start not in best or weight > best[start][2]):
                stop = end
                while stop < n and text[stop].isalnum():
                    stop += 1
                best[start] = (start, stop, weight)
    return list(best.values())


def phrases(text: str, start: int, end: int) -> list[str]:
    """The word with the one before it, and with the one after it."""
    before = re.search(r"([^\W_]+)[\W_]+$", text[max(0, start - 64) : start])
    after = re.match(r"[\W_]+([^\W_]+)", text[end : end + 64])
    word = text[start:end]
    return ([f"{before[1]} {word}"] if before else []) + ([f"{word} {after[1]}"] if after else [])


def load(automaton: ahocorasick.Automaton | None, exceptions: frozenset[str], text: str) -> tuple[float, int]:
    """Summed weight of the hits outside exceptions, and the number of words."""
    n = text.count(" ") + text.count("\n") + 1
    if automaton is None:
        return 0.0, n
    folded = fold(text)
    total = 0.0
    for start, end, weight in hits(automaton, folded):
        if not exceptions or not exceptions.intersection(phrases(folded, start, end)):
            total += weight
    return total, n


def entries(text: str) -> set[str]:
    words = set(_WORD.findall(fold(text)))
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) >= k}


def _counted(rows: DataFrame, count, least: int) -> dict[str, int]:
    """Rows that hold each entry, for entries of ``least`` rows or more. Tasks count before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found: Counter = Counter()
            for t in texts(part, "text"):
                found.update(count(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["entry", "n"])

    counts = rows.select("text").mapInArrow(run, "entry string, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    return {r.entry: r.n for r in counts.where(F.col("n") >= least).collect()}  # bounded by the sample


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from rows of ``labels`` (doc_id, toxic) whose crc32(doc_id) mod 5 is not 0."""
    marked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (doc_bucket(F.col("doc_id"), 5) != 0))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    )
    chosen = marked.sparkSession.createDataFrame(marked.collect(), "doc_id long, toxic int")  # at most sample_rows pairs
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic").groupBy("text").agg(F.max("toxic").alias("toxic")).persist()
    try:
        return _fit(rows)
    finally:
        rows.unpersist()


def _fit(rows: DataFrame) -> Model:
    sizes = {r.toxic: r["count"] for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return Model(offset=math.inf if n_toxic else -math.inf)
    toxic, clean = rows.where("toxic > 0"), rows.where("toxic <= 0")
    usual = _counted(toxic, entries, max(LEAST_TOXIC_ROWS, math.ceil(LEAST_TOXIC_SHARE * n_toxic)))
    candidates = frozenset(usual)
    against = _counted(clean, lambda t: entries(t) & candidates, 1)
    odds = lambda k, n: math.log((k + 0.5) / (n - k + 0.5))
    weights = {e: w for e, k in usual.items() if (w := odds(k, n_toxic) - odds(against.get(e, 0), n_clean)) >= LEAST_WEIGHT}
    # An entry says nothing new beside a shorter stem of its own that is as telling.
    kept = {e: w for e, w in weights.items() if not any(weights.get(e.rstrip("*")[:k] + "*", -1) >= w - 0.7 for k in STEMS if k < len(e.rstrip("*")) + (not e.endswith("*")))}
    model = Model(kept)
    automaton = model.automaton()

    def around(text: str) -> set[str]:
        folded = fold(text)
        return {p for s, e, _ in hits(automaton, folded) for p in phrases(folded, s, e)} if automaton else set()

    harmless = _counted(clean, around, LEAST_EXCEPTION_ROWS)
    if harmless:
        names = frozenset(harmless)
        harmful = _counted(toxic, lambda t: around(t) & names, 1)
        model.exceptions = frozenset(p for p, k in harmless.items() if odds(harmful.get(p, 0), n_toxic) < odds(k, n_clean))
    exceptions = model.exceptions

    def loads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            total, n = zip(*(load(automaton, exceptions, t) for t in texts(part, "text")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(total, pa.float64()), pa.array(n, pa.int64()), part.column("toxic")], ["load", "n", "toxic"])

    found = rows.mapInArrow(loads, "load double, n long, toxic int").collect()  # three numbers per row of the sample
    total, n, y = (np.array(x, float) for x in zip(*found, strict=True))
    model.power, model.slope, model.offset = curve(total, n, (y > 0).astype(float))
    return model


def curve(total: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Power of the length, slope and offset with the least log loss (Newton steps with a small penalty)."""
    best = (math.inf, 0.0, 0.0, 0.0)
    for power in POWERS:
        x = np.stack([np.log1p(total / n**power * 10), np.ones(len(y))], 1)
        beta = np.zeros(2)
        penalty = np.diag([1e-2, 1e-3])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
            beta += step
            if np.abs(step).max() < 1e-8:
                break
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))), 1e-9, 1 - 1e-9)
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        if loss < best[0] - 1e-9:
            best = (loss, power, max(0.0, float(beta[0])), float(beta[1]))
    return best[1:]


def score(docs: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """All columns, and ``score`` between 0 and 1 (a column of that name is replaced)."""
    fields = [f for f in docs.schema.fields if f.name != "score"]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for part in slices(batches, column):
            out = []
            for t in texts(part, column):
                total, n = load(automaton, model.exceptions, t)
                z = model.offset + model.slope * math.log1p(total / n**model.power * 10)
                out.append(1 / (1 + math.exp(-min(700.0, max(-700.0, z)))))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(out, pa.float64())], [*names, "score"])

    return docs.drop("score").mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType())]))
