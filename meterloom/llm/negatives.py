"""Hard negatives from labelled vectors, found exactly through an inverted multi-index.

A vector is cut into two halves. Each half has a codebook (k-means on a bounded sample), and the pair of nearest codewords
names a row's cell; every row is indexed. For an anchor the score of any row of cell (i, j) is at most

    first half . codeword i + |first half| * radius i  +  second half . codeword j + |second half| * radius j

so a heap walks the two sorted lists of half bounds and yields cells by falling sum (multi-sequence). A *window* asks for
the best ``k`` rows of a score range with the anchor's label or with another one. It is certified, and needs no further
cell, once the next sum is below the score that a row must have to change it; a cell whose least possible score lies above
the window is passed over.

Positives are one window over all scores; each positive then opens one window of negatives. Each search has two rounds of
the same job: the first cells give a score that the k-th row reaches at least, then all cells that may hold a better one are
read. Both rounds are joins on *shards*: at most ``shard_rows`` rows of neighbouring cells (a larger cell has several),
met by the anchors that visit them, of which a task reads at most a group of ``anchor_rows`` and holds one batch. A third
of all rows in one cell, one label or with one vector is thereby dealt over many tasks. Scores are exact integers.

Defined cases: rows without an id, label or vector, or with a null or non-finite component, take no part. Shorter vectors
count as filled up with zeros. Rows that repeat an id are rows of their own, but never a partner of that id; repeated anchors
give repeated results. Equal scores go by the smaller id; scores beyond 64 bits stop at the bound. An empty table, no anchors, or
no row in a window give no rows.
Other columns are left out.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import stored

CODEWORDS = 32  # of each half: at most CODEWORDS ** 2 cells
SAMPLE_ROWS = 8192  # that the codebooks are fitted on
SHARD_ROWS = 8192
ANCHOR_ROWS = 16384
SEED_ROWS = 4096  # rows of the cells that the first round reads for an anchor
SCALE = 256.0
LEAST, MOST = -(1 << 63), (1 << 63) - 1
EXACT = float(1 << 53)  # sums of integers below it are exact in doubles, in any order

INDEX = "uid long, id long, label long, vector binary, cell int, first double, second double"
FOUND = "uid long, window int, id long, score long"


def whole(vectors: Column) -> Column:
    """Are all components there and finite, also when scaled?"""
    return F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(np.finfo(float).max / SCALE)))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of doubles as rows of scaled whole numbers, filled up with zeros."""
    out = np.zeros((len(column), dims))
    sizes = np.diff(column.offsets.to_numpy())
    out[np.arange(dims) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(out * SCALE)


def kmeans(rows: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Codewords of the rows; at most as many as there are different rows."""
    rows = np.unique(rows, axis=0)
    centres = rows[np.random.default_rng(7).choice(len(rows), min(k, len(rows)), replace=False)]
    for _ in range(rounds):
        near = nearest(rows, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * rows @ centres.T).argmin(1)


@dataclass
class Index:
    """Rows by cell in the shared folder, and what every task needs to know of the cells (bounded by CODEWORDS ** 2)."""

    rows: DataFrame  # INDEX
    dims: int
    books: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray  # rows of cell (i, j)
    radii: tuple[np.ndarray, np.ndarray]  # greatest distance of a cell's rows to its codewords, of either half
    shards: np.ndarray  # first shard of each cell
    parts: np.ndarray  # shards of each cell


def build(rows: DataFrame, codewords: int = CODEWORDS, sample_rows: int = SAMPLE_ROWS, shard_rows: int = SHARD_ROWS) -> Index | None:
    """Index all whole rows of (vec_id, embedding, label); None if there are none."""
    rows = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & whole(F.col("vector")))
    # The sample: rows of the smallest hashes, so that it does not depend on how the table is dealt out.
    sample = rows.orderBy(F.xxhash64("id"), "id", "label", "vector").limit(sample_rows).select("vector").toArrow().column(0).combine_chunks()
    if not len(sample):
        return None
    dims = max(rows.agg(F.max(F.size("vector"))).first()[0], 2)
    half = (dims + 1) // 2
    seen = matrix(sample, dims)
    books = kmeans(seen[:, :half], codewords), kmeans(seen[:, half:], codewords)
    width = len(books[1])

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = matrix(batch.column("vector"), dims)
            codes = [nearest(points[:, part], book) for part, book in zip((slice(half), slice(half, dims)), books, strict=True)]
            away = [np.sqrt(((points[:, part] - book[c]) ** 2).sum(1)) for part, book, c in zip((slice(half), slice(half, dims)), books, codes, strict=True)]
            cells = (codes[0] * width + codes[1]).astype(np.int32)
            blob = pa.array([p.tobytes() for p in points], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("id"), batch.column("label"), blob, pa.array(cells), pa.array(away[0]), pa.array(away[1])], [c.split(" ")[0] for c in INDEX.split(", ")])

    indexed = stored(rows.withColumn("uid", F.monotonically_increasing_id()).select("uid", "id", "label", "vector").mapInArrow(assigned, INDEX), "multi-index")
    cells = indexed.groupBy("cell").agg(F.count("*").alias("n"), F.max("first").alias("first"), F.max("second").alias("second")).collect()
    counts, radii = np.zeros(len(books[0]) * width, np.int64), (np.zeros(len(books[0]) * width), np.zeros(len(books[0]) * width))
    for row in cells:
        counts[row.cell], radii[0][row.cell], radii[1][row.cell] = row.n, row.first, row.second
    shards, parts, at, held = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64), 0, 0
    for cell, n in enumerate(counts):
        if held and held + n > shard_rows:
            at, held = at + 1, 0
        shards[cell], parts[cell] = at, max(-(-n // shard_rows), 1)
        held += n
        if parts[cell] > 1:
            at, held = at + parts[cell], 0
    return Index(indexed, dims, books, counts, radii, shards, parts)


def by_bound(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Pairs (i, j) by falling first[i] + second[j]: each step pops the best of a heap that holds the next pairs."""
    a, b = np.argsort(-first, kind="stable").tolist(), np.argsort(-second, kind="stable").tolist()
    first, second = first.tolist(), second.tolist()
    heap = [(-first[a[0]] - second[b[0]], 0, 0)]
    while heap:
        bound, i, j = heapq.heappop(heap)
        yield -bound, a[i], b[j]
        if j + 1 < len(b):
            heapq.heappush(heap, (-first[a[i]] - second[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (-first[a[i + 1]] - second[b[0]], i + 1, 0))


@dataclass
class Walk:
    """What a task needs to choose the cells of an anchor."""

    books: tuple[np.ndarray, np.ndarray]
    counts: np.ndarray
    radii: tuple[np.ndarray, np.ndarray]
    seed_rows: int

    def __post_init__(self) -> None:
        width = len(self.books[1])
        self.width = width
        self.tops = self.radii[0].reshape(-1, width).max(1), self.radii[1].reshape(-1, width).max(0)

    def cells(self, anchor: np.ndarray, needs: list[int], highs: list[int], seeding: bool) -> list[int]:
        """Cells that may hold a row of some window scoring from its need to its high; of those the first if seeding."""
        if not needs:
            return []
        half = self.books[0].shape[1]
        parts = anchor[:half], anchor[half:]
        dots = [book @ part for book, part in zip(self.books, parts, strict=True)]
        norms = [float(np.sqrt((part**2).sum())) for part in parts]
        # Sums in doubles may be off by far less than this.
        slack = 1e-3 + 1e-9 * sum(float(np.abs(d).max()) + n * float(t.max()) for d, n, t in zip(dots, norms, self.tops, strict=True))
        open_windows = [(n, h) for n, h in zip(needs, highs, strict=True) if n <= h]
        least = min((n for n, _ in open_windows), default=None)
        found, rows = [], 0
        if least is None:
            return found
        for bound, i, j in by_bound(dots[0] + norms[0] * self.tops[0], dots[1] + norms[1] * self.tops[1]):
            if bound + slack < least:  # certified: no cell that follows can change a window
                break
            cell = i * self.width + j
            if not self.counts[cell]:
                continue
            centre, reach = dots[0][i] + dots[1][j], norms[0] * self.radii[0][cell] + norms[1] * self.radii[1][cell] + slack
            if any(centre + reach >= need and centre - reach <= high for need, high in open_windows):
                found.append(cell)
                rows += int(self.counts[cell])
                if seeding and rows >= self.seed_rows:
                    break
        return found


class Shard:
    """Rows of one shard, by cell."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        table = pa.Table.from_batches(batches)
        self.ids = table.column("id").to_numpy()
        self.labels = table.column("label").to_numpy()
        self.points = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float64).reshape(len(self.ids), -1)
        cells = table.column("cell").to_numpy()
        self.cells, starts = np.unique(cells, return_index=True)
        self.edges = np.append(starts, len(cells))
        self.reach = float(np.sqrt((self.points**2).sum(1)).max())

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products."""
        if self.reach * float(np.sqrt((anchor**2).sum())) < EXACT:
            return (self.points[rows] @ anchor).astype(np.int64)
        other = [int(x) for x in anchor]
        return np.array([min(max(sum(int(x) * y for x, y in zip(p, other, strict=True)), LEAST), MOST) for p in self.points[rows]], np.int64)

    def best(self, visit: dict, same: bool, k: int) -> Iterator[tuple[int, int, int]]:
        """(window, id, score) of the best rows of each window in the cells visited."""
        anchor = np.frombuffer(visit["vector"])
        places = np.searchsorted(self.cells, np.frombuffer(visit["cells"], np.int32))
        rows = np.concatenate([np.arange(self.edges[p], self.edges[p + 1]) for p in places])
        rows = rows[((self.labels[rows] == visit["label"]) == same) & (self.ids[rows] != visit["id"])]
        scores = self.scores(rows, anchor)
        for window, (need, high) in enumerate(zip(visit["needs"], visit["highs"], strict=True)):
            inside = np.flatnonzero((scores >= need) & (scores <= high))
            if len(inside) > k:  # all rows that equal the k-th stay until ids have been compared
                inside = inside[scores[inside] >= np.partition(scores[inside], len(inside) - k)[len(inside) - k]]
            order = np.lexsort((self.ids[rows[inside]], -scores[inside]))[:k]
            for at in inside[order]:
                yield window, int(self.ids[rows[at]]), int(scores[at])


def read(index: Index, anchors: DataFrame, same: bool, k: int, seeding: bool, shard_rows: int, anchor_rows: int, seed_rows: int) -> DataFrame:
    """One round: the best rows (FOUND) of each window, by shard. ``anchors``: uid, id, label, vector, needs, highs."""
    groups = max(-(-anchors.count() // anchor_rows), 1)
    walk = Walk(index.books, index.counts, index.radii, seed_rows)
    shards, parts = index.shards, index.parts
    visit_type = "shard long, grp int, id long, label long, vector binary, cell int, uid long, needs array<long>, highs array<long>, cells binary"
    names = [c.split(" ")[0] for c in visit_type.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        rows: list[tuple] = []
        for batch in batches:
            for a in batch.to_pylist():
                cells = np.array(sorted(walk.cells(np.frombuffer(a["vector"]), a["needs"], a["highs"], seeding)), np.int32)
                by_shard: dict[int, list[int]] = {}
                for cell in cells.tolist():
                    for part in range(int(parts[cell])):
                        by_shard.setdefault(int(shards[cell]) + part, []).append(cell)
                for shard, own in by_shard.items():
                    rows.append((shard, a["uid"] % groups, a["id"], a["label"], a["vector"], None, a["uid"], a["needs"], a["highs"], np.array(own, np.int32).tobytes()))
                if len(rows) >= 1024:
                    yield as_batch(rows)
                    rows = []
        if rows:
            yield as_batch(rows)

    # At most CODEWORDS ** 2 rows.
    plan = index.rows.sparkSession.createDataFrame([(int(c), int(s), int(p)) for c, (s, p) in enumerate(zip(shards, parts, strict=True))], "cell int, shard long, parts long")
    held = index.rows.join(F.broadcast(plan), "cell").select(
        (F.col("shard") + F.pmod(F.xxhash64("uid"), "parts")).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), "id", "label", "vector", "cell",
    )
    for name, kind in (c.split(" ") for c in visit_type.split(", ")[6:]):
        held = held.withColumn(name, F.lit(None).cast(kind))
    dealt = anchors.mapInArrow(visits, visit_type).unionByName(held).repartition("shard", "grp").sortWithinPartitions("shard", "grp", F.col("cell").asc_nulls_last())

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, shard = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column("shard").to_numpy(), batch.column("grp").to_numpy(), batch.column("cell").is_null().to_numpy(zero_copy_only=False)])
            edges = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            out = []
            for start, stop in zip(edges, edges[1:], strict=False):
                run = batch.slice(start, stop - start)
                if key != (here := (marks[0][start], marks[1][start])):
                    key, waiting, shard = here, [], None
                if not marks[2][start]:
                    waiting.append(run)
                    continue
                if shard is None:
                    shard, waiting = Shard(waiting), []
                for visit in run.select(["id", "label", "vector", "uid", "needs", "highs", "cells"]).to_pylist():
                    out += [(visit["uid"], *hit) for hit in shard.best(visit, same, k)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["uid", "window", "id", "score"])

    ranked = Window.partitionBy("uid", "window").orderBy(F.desc("score"), "id")
    return dealt.mapInArrow(met, FOUND).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def search(index: Index, anchors: DataFrame, same: bool, k: int, shard_rows: int, anchor_rows: int, seed_rows: int) -> DataFrame:
    """The best ``k`` rows of each window: uid, window, id, score, rank. ``anchors``: uid, id, label, vector, lows, highs."""
    bounds = shard_rows, anchor_rows, seed_rows
    seeds = read(index, anchors.withColumn("needs", F.col("lows")), same, k, True, *bounds)
    reached = seeds.where(F.col("rank") == k).groupBy("uid").agg(F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("reached"))
    needs = F.transform("lows", lambda low, i: F.coalesce(F.greatest(low, F.try_element_at("reached", i)), low))
    return read(index, anchors.join(reached, "uid", "left").withColumn("needs", needs).drop("reached"), same, k, False, *bounds)


def mine(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    codewords: int = CODEWORDS,
    sample_rows: int = SAMPLE_ROWS,
    shard_rows: int = SHARD_ROWS,
    anchor_rows: int = ANCHOR_ROWS,
    seed_rows: int = SEED_ROWS,
) -> DataFrame:
    """For each anchor (a condition on ``vec_id``) and each of its best ``positives`` rows of the same label, the best
    ``negatives`` rows of other labels that score from 80 % to 100 % of the positive.

    ``rows``: vec_id, embedding, label. Result: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    index = build(rows, codewords, sample_rows, shard_rows)
    if index is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    bounds = shard_rows, anchor_rows, seed_rows
    chosen = index.rows.withColumn("vec_id", F.col("id")).where(anchors).select("uid", "id", "label", "vector")
    everything = chosen.withColumns({"lows": F.array(F.lit(LEAST)), "highs": F.array(F.lit(MOST))})
    best = stored(search(index, everything, True, positives, *bounds).select("uid", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Whole scores from 80 % of a positive one; a negative one leaves none between 80 % and 100 % of itself.
    low = lambda p: F.when(p >= 0, p - F.call_function("div", p, F.lit(5))).otherwise(MOST)
    windows = best.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("window", "positive_score"))), lambda x: x["positive_score"]).alias("highs"))
    ranged = chosen.join(windows, "uid").withColumn("lows", F.transform("highs", low))
    hard = search(index, ranged, False, negatives, *bounds).select("uid", "window", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = chosen.select("uid", F.col("id").alias("anchor_id"))
    return best.join(hard, ["uid", "window"]).join(named, "uid").select("anchor_id", "positive_id", F.col("rank").cast("int"), "negative_id", "positive_score", "negative_score")
