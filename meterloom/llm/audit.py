"""How far the sources of a language are from each other, priced from products of one-hot level matrices.

A *level* of a group (lang, source) is a count that some term has in it, zero included. Let X have a row for each kept term of
the language and a column for each (group, level), with a one where the term has that level in that group. Then X' X holds
every joint table: in how many terms group g has level a while group h has level b. A price that depends on two levels alone
is summed over terms by weighing the joint table with the prices of its cells, without walking the terms again.

X is never whole anywhere. Terms are dealt by hash into blocks of about ``term_rows`` terms, groups into blocks of
``group_rows`` sources, and a task forms the product of one term block for one pair of group blocks, in slices of terms whose
columns number at most ``columns`` (terms are sorted by count, so rare ones share few levels). Products of ones are exact in
32-bit floats because a slice has fewer than 2 ** 24 terms; prices and sums are integers. Terms that neither of two group
blocks has are counted, not listed: all have level zero in both.

Words are counted inside tasks first, so a word, source or language with a third of all rows is shuffled as one row per task
and flush. Results per group: for every other source of the language the price summed over all kept terms (part ``pair``),
and the ``top`` terms that the group has more often than its language (part ``term``).

Defined cases: null text, lang and source are ''. Each row is a document, also a repeated one. A group without words, or a
language without kept terms, has its pairs with value 0. Equal values go by the item's UTF-8 bytes. Very long texts are read
in pieces cut between words. An empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import stored

DOCUMENTS = 10  # a kept term is in as many documents of its language at least
TOP = 10
TERM_ROWS = 8192
GROUP_ROWS = 64
COLUMNS = 1024
SLICE_ROWS = 4096  # terms of a slice at most
HELD = 300_000  # counts that a task holds before it passes them on
PIECE = 4_000_000  # bytes of a text read at a time
UNIT = 1_000_000_000

#: Bytes of terms: a to z, A to Z lowered, and all bytes of other scripts. The rest separates.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            cut = text.rfind(b" ", at, end)
            cut = cut if cut > at else text.find(b" ", end)
            end = cut if cut > 0 else len(text)
        yield text[at:end].split()
        at = end


COUNTS = "lang string, source string, term string, n long, documents long"


def counted(docs: DataFrame) -> DataFrame:
    """Words of each (lang, source): how often and in how many documents; a null term stands for the group itself."""
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (often, documents) in held.items():
                terms, n = [t.decode("utf-8", "replace") for t in often] + [None], len(often) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(terms, pa.string()), pa.array([*often.values(), 0], pa.int64()), pa.array([*(documents[t] for t in often), 0], pa.int64())],
                    [c.split(" ")[0] for c in COUNTS.split(", ")],
                )
            held.clear()

        size = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, source, at in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), range(batch.num_rows), strict=True):
                often, documents = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(often)
                own: Counter = Counter()
                for words in _pieces(texts[at].as_py().translate(_FOLD)):
                    own.update(words)
                often.update(own)
                documents.update(own.keys())
                size += len(often) - before + 1
                if size > HELD:
                    yield from flushed()
                    size = 0
        yield from flushed()

    return docs.mapInArrow(run, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * kept)), in decimals, as counts may be too large for 64 bits."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (wide(n) + 2).cast("decimal(20,0)"), (wide(total) + 2 * wide(kept)).cast("decimal(20,0)"))


def price(p: Column, q: Column) -> Column:
    """floor((p - q) ** 2 / (p + q)); shares are at most UNIT + 1, so 64 bits hold the square."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def levels(counts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Column of the one-hot matrix for each cell of (term, group), and the levels of each group."""
    at, out, found = 0, np.empty(counts.shape, np.int64), []
    for g in range(counts.shape[1]):
        values, places = np.unique(counts[:, g], return_inverse=True)
        out[:, g] = at + places
        found.append(values)
        at += len(values)
    return out, found


def priced(counts: np.ndarray, totals: list[int], kept: int, own: int, columns: int = COLUMNS) -> np.ndarray:
    """Price of each pair (g of the first ``own`` groups, h of the rest; of all groups with themselves if ``own`` is all),
    summed over the terms (rows) of ``counts``."""
    groups = counts.shape[1]
    split = own < groups
    out = np.zeros((own, groups - own if split else groups), np.int64)
    counts = counts[np.argsort(counts.max(1), kind="stable")]
    at, step = 0, SLICE_ROWS
    while at < len(counts):
        part = counts[at : at + step]
        places, found = levels(part)
        wide = sum(map(len, found))
        if wide > columns and len(part) > 1:
            step = max(len(part) // 2, 1)
            continue
        ones = np.zeros((len(part), wide), np.float32)
        ones[np.arange(len(part))[:, None], places] = 1
        shares = np.array([1 + UNIT * (int(n) + 2) // (totals[g] + 2 * kept) for g in range(groups) for n in found[g]], np.int64)
        starts = np.cumsum([0, *map(len, found)])
        left, right = (slice(0, starts[own]), slice(starts[own], wide)) if split else (slice(0, wide), slice(0, wide))
        joint = (ones[:, left].T @ ones[:, right]).astype(np.int64)  # X' X
        p, q = shares[left][:, None], shares[right]
        weighed = joint * ((p - q) ** 2 // (p + q))
        rows, cols = (starts[:own], starts[own:-1] - starts[own]) if split else (starts[:-1], starts[:-1])
        out += np.add.reduceat(np.add.reduceat(weighed, rows, axis=0), cols, axis=1)
        at += len(part)
        if wide < columns // 2:
            step = min(step * 2, SLICE_ROWS)
    return out


def audit(docs: DataFrame, documents: int = DOCUMENTS, top: int = TOP, term_rows: int = TERM_ROWS, group_rows: int = GROUP_ROWS, columns: int = COLUMNS) -> DataFrame:
    """lang, source, part, item, value, rank of the documents' (text, lang, source)."""
    term = Window.partitionBy("lang", "term")
    first = F.row_number().over(term.orderBy("source")) == 1
    found = counted(docs).withColumns({"everywhere": F.sum("n").over(term), "within": F.sum("documents").over(term), "first": first.cast("int")})
    # Kept terms of each group, and the groups themselves (null terms). A term has at most one row per source.
    table = stored(found.where(F.col("term").isNull() | (F.col("within") >= documents)).select("lang", "source", "term", "n", "everywhere", "first"), "audit-counts")

    own = table.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("term").isNotNull(), F.col("first")).otherwise(0)).alias("firsts"))
    by_lang = Window.partitionBy("lang")
    groups = own.select(
        "lang", "source", "total", F.sum("total").over(by_lang).alias("lang_total"), F.sum("firsts").over(by_lang).alias("kept"),
        (F.row_number().over(by_lang.orderBy("source")) - 1).alias("at"), F.count("*").over(by_lang).alias("groups"),
    )
    groups = stored(groups, "audit-groups")
    terms = table.where(F.col("term").isNotNull()).join(groups, ["lang", "source"])

    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("everywhere"), F.col("lang_total"), F.col("kept"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    single = terms.withColumns({"p": p, "q": q}).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))
    single = single.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)

    # A row of group block b meets every block: units (i, j) with i <= j and b one of them.
    block = F.floor(F.col("at") / group_rows).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.floor((F.col("groups") - 1) / group_rows).cast("int")))
    blocks = F.ceil(F.col("kept") / term_rows).cast("int")
    unit = [F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")]
    cells = terms.withColumn("block", block).withColumn("other", other).select("lang", *unit, F.pmod(F.xxhash64("term"), blocks).cast("int").alias("t"), "term", "at", "n", "total", "kept")
    marks = groups.where("kept > 0").withColumn("block", block).withColumn("other", other).withColumn("t", F.explode(F.sequence(F.lit(0), blocks - 1)))
    marks = marks.select("lang", *unit, "t", F.lit(None).cast("string").alias("term"), "at", F.lit(0).cast("long").alias("n"), "total", "kept")

    def product(key: tuple, cells: pd.DataFrame) -> pd.DataFrame:
        head = cells[cells["term"].isna()].sort_values("at")
        at = head["at"].to_numpy()
        body = cells[cells["term"].notna()]
        rows, names = pd.factorize(body["term"])
        counts = np.zeros((len(names), len(at)), np.int64)
        counts[rows, np.searchsorted(at, body["at"].to_numpy())] = body["n"].to_numpy()
        i, j = key[1], key[2]
        mine = int((at < (i + 1) * group_rows).sum()) if i != j else len(at)
        values = priced(counts, [int(x) for x in head["total"]], int(head["kept"].iloc[0]), mine, columns)
        g, h = np.meshgrid(at[:mine], at[mine:] if i != j else at, indexing="ij")
        out = pd.DataFrame({"lang": key[0], "g": g.ravel(), "h": h.ravel(), "value": values.ravel(), "seen": len(names)})
        return out[out["g"] != out["h"]]

    sums = cells.unionByName(marks).groupBy("lang", "i", "j", "t").applyInPandas(product, "lang string, g int, h int, value long, seen long")
    # The product is symmetric: pairs of different blocks are formed once and turned.
    turned = sums.where(F.floor(F.col("g") / group_rows) != F.floor(F.col("h") / group_rows)).select("lang", F.col("h").alias("g"), F.col("g").alias("h"), "value", "seen")
    summed = sums.unionByName(turned).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))

    zero = share(F.lit(0), F.col("total"), F.col("kept"))
    sides = groups.withColumn("zero", F.when(F.col("kept") > 0, zero))
    left = sides.select("lang", F.col("at").alias("g"), "source", "kept", F.col("zero").alias("p"))
    right = sides.select("lang", F.col("at").alias("h"), F.col("source").alias("item"), F.col("zero").alias("q"))
    pairs = left.join(right, (left["lang"] == right["lang"]) & (left["g"] != right["h"])).drop(right["lang"])
    rest = (F.col("kept") - F.coalesce("seen", F.lit(0))) * price(F.col("p"), F.col("q"))
    pairs = pairs.join(summed, ["lang", "g", "h"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce(F.coalesce("value", F.lit(0)) + rest, F.lit(0)).cast("long").alias("value"))
    return pairs.withColumn("rank", F.row_number().over(ranked)).unionByName(single).select("lang", "source", "part", "item", F.col("value").cast("long"), F.col("rank").cast("int"))
