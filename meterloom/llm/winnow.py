"""Document fingerprints by winnowing.

Hashes of all k-grams of code points come from doubling (a k-gram is made of two halves), the minimum of every window of
``window`` hashes from doubling as well; of equal minima the rightmost counts, and a place is kept once. Any two texts
that share ``window + k - 1`` code points in a row share a kept hash, and no match shorter than ``k`` counts. Positions
are kept with the hashes.

A text shorter than ``k`` has the hash of all of it as its only mark, a text with fewer k-grams than ``window`` the
minimum of those it has. Null counts as the empty text, whose fingerprint is the empty string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import slices, texts

K = 8
WINDOW = 8
FACTOR = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def kgrams(points: np.ndarray, k: int) -> np.ndarray:
    """Rolling hash of each k-gram: sum of code points times powers of an odd factor, mixed."""
    hashes = points.astype(np.uint64) + np.uint64(1)
    total, size = None, 0
    width, power = 1, FACTOR
    while width <= k:  # binary parts of k, joined from the left
        if k & width:
            if total is None:
                total, size = hashes, width
            else:
                n = len(points) - size - width + 1
                total = hashes[:n] * np.uint64(pow(FACTOR, size, 1 << 64)) + total[width : width + n]
                size += width
        n = len(points) - 2 * width + 1
        if n <= 0:
            break
        hashes = hashes[:n] * np.uint64(power) + hashes[width : width + n]
        width, power = 2 * width, power * power % (1 << 64)
    return _mix(total)


def marks(text: str, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept hashes (32 bits) and their positions, in order of position."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not len(points):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = kgrams(points, min(k, len(points))) >> np.uint64(32)
    # One number orders by hash, then by the position from the right.
    low = hashes << np.uint64(32) | np.uint64(0xFFFFFFFF) - np.arange(len(hashes), dtype=np.uint64)
    window, width = min(window, len(hashes)), 1
    while 2 * width <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < window:
        low = np.minimum(low[: len(low) - (window - width)], low[window - width :])
    low = low[np.append(True, low[1:] != low[:-1])]
    return low >> np.uint64(32), (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64)


def written(hashes: np.ndarray, places: np.ndarray) -> str:
    """``hash@place`` of each mark."""
    return " ".join(f"{h:x}@{p}" for h, p in zip(hashes.tolist(), places.tolist(), strict=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of the distinct hashes of two fingerprints; two empty ones are alike, an empty and another not."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, column: str = "text") -> DataFrame:
    """All columns, and ``fingerprint`` (a column of that name is replaced)."""
    fields = [f for f in docs.schema.fields if f.name != "fingerprint"]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            prints = [written(*marks(t, k, window)) for t in texts(part, column)]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(prints, pa.string())], [*names, "fingerprint"])

    return docs.drop("fingerprint").mapInArrow(run, T.StructType([*fields, T.StructField("fingerprint", T.StringType())]))


RESULT = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
RESULT_NAMES = [c.split(" ")[0] for c in RESULT.split(", ")]
RESULT_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def edit(text: str, following: str) -> str:
    """The last third of a text replaced by as many characters from the beginning of another."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


def with_edits(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness to each other and to the next document's.

    Next is by descending doc_id (nulls last; equal ids by descending text), the first again after the last. A table of
    one row is its own next; an empty one gives no rows. Other columns are left out. ``edited`` is the edited text.

    Ids are cut into ranges at quantiles, one per shuffle partition. The first row of each range (one per range, found
    from the ids alone) is also sent to the range before it, where it only follows. So texts are shuffled once, and a
    range is read once in order.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.unique(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n))

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        # Descending: the highest ids are range 0, null ids come last.
        found = len(cuts) - np.searchsorted(cuts, ids.fillna(-np.inf).to_numpy(float), "right")
        return pd.Series(np.where(ids.isna(), len(cuts) + 1, found).astype(np.int32))

    cut = docs.select(range_of("doc_id").alias("range"), "doc_id", "text", F.lit(False).alias("follows"))
    tops = cut.groupBy("range").agg(F.max("doc_id").alias("doc_id")).orderBy("range").collect()  # one row per range
    if not tops:
        return spark.createDataFrame([], RESULT)
    before = {r.range: tops[i - 1].range for i, r in enumerate(tops)}
    heads = [(r.range, before[r.range], r.doc_id) for r in tops]
    wanted = F.broadcast(spark.createDataFrame(heads, "range int, before int, doc_id long"))
    firsts = (
        cut.join(wanted, (cut["range"] == wanted["range"]) & cut["doc_id"].eqNullSafe(wanted["doc_id"]), "inner")
        .groupBy(wanted["before"].alias("range")).agg(F.max("text").alias("text"))
        .select("range", F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("follows"))
    )
    order = ["range", "follows", F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last()]
    ranged = cut.unionByName(firsts).repartition(n, "range").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # a document whose next one has not been read yet
        for group in slices(batches, "text", 1_000_000):
            rows = []
            cells = zip(group.column("doc_id").to_pylist(), texts(group, "text"), group.column("follows").to_pylist(), strict=True)
            for doc_id, text, follows in cells:
                own = marks(text, k, window)
                if before is not None:
                    i, t, m = before
                    changed = edit(t, text)
                    new = marks(changed, k, window)
                    rows.append((i, len(t), changed, written(*m), written(*new), likeness(m[0], new[0]), likeness(m[0], own[0])))
                before = None if follows else (doc_id, text, own)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), RESULT_TYPES, strict=True)], RESULT_NAMES)

    return ranged.mapInArrow(run, RESULT)
