"""Sequence packing by non-negative least squares over a length histogram.

Every document is cut into full windows and a rest. The lengths of all pieces make one histogram (at most ``size``
numbers, whatever the corpus). Its shallow combinations — pairs and triples of lengths that fill a window exactly — are
the columns of a least-squares problem over the histogram with non-negative repeat counts, solved by multiplicative
steps. Counts are rounded down and reduced where they would use more pieces than there are. What is left over is packed
greedily: pieces are laid end to end, longest first, and cut where a window is full, so only the last window is not.

Pieces wait in the shared folder with two bytes per id where the vocabulary allows it.

A piece needs its rank among all pieces of its length to find its combination. Tasks count their own pieces; the counts
are summed over tasks per length, and no length is ever ordered as a whole.

Null and empty texts are one end id. Repeated rows are packed each. An empty table gives no sequences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .batches import stored

SIZE = 1024
TRIPLES_PER_LENGTH = 24
STEPS = 400

PIECE = "doc_id long, start long, length long, doc_tokens long, part long, slot long, ids binary"
PACKED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def combinations(histogram: np.ndarray, size: int, per_length: int = TRIPLES_PER_LENGTH) -> np.ndarray:
    """Multisets of at most three lengths that fill a window, as rows padded by 0.

    All pairs; of the triples, for every longest length those whose rarest member is most frequent.
    """
    rows = [(size, 0, 0)]
    rows += [(a, size - a, 0) for a in range(-(-size // 2), size) if histogram[a] and histogram[size - a]]
    present = np.flatnonzero(histogram)
    for a in present[(present >= -(-size // 3)) & (present <= size - 2)]:
        rest = size - a
        b = present[(present * 2 >= rest) & (present <= min(a, rest - 1))]
        c = rest - b
        ok = histogram[c] > 0
        b, c = b[ok], c[ok]
        best = np.argsort(-np.minimum(histogram[b], histogram[c]), kind="stable")[:per_length]
        rows += [(int(a), int(x), int(y)) for x, y in zip(b[best], c[best], strict=True)]
    return np.array(rows, np.int64)


def solve(histogram: np.ndarray, combos: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Repeat counts >= 0 that make the combinations' lengths meet the histogram, weighted by length.

    Multiplicative updates for non-negative least squares: all terms are sums over the three members, so no matrix is built.
    """
    weight = np.arange(len(histogram), dtype=float) ** 2
    weight[0] = 0.0
    target = weight * histogram
    x = np.where(combos > 0, histogram[combos], np.inf).min(axis=1) / 3 + 1e-6
    top = target[combos].sum(axis=1)
    for _ in range(steps):
        made = np.zeros(len(histogram))
        for k in range(3):
            made += np.bincount(combos[:, k], weights=x, minlength=len(histogram))
        made[0] = 0
        x *= top / np.maximum((weight * made)[combos].sum(axis=1), 1e-12)
    return x


class Plan:
    """Where the n-th piece of each length goes: combinations first, then a stream of leftovers."""

    def __init__(self, histogram: np.ndarray, size: int):
        self.size = size
        left = histogram.astype(np.int64).copy()
        combos = combinations(left, size)
        repeat = np.floor(solve(histogram.astype(float), combos) + 1e-9).astype(np.int64)
        slots: list[list[tuple[int, int, int]]] = [[] for _ in range(size + 1)]  # first sequence, count, offset
        first = 0

        def take(combo: list[int], n: int) -> None:
            nonlocal first
            offset = 0
            for length in combo:
                slots[length].append((first, n, offset))
                left[length] -= n
                offset += length
            first += n

        for i in np.argsort(-repeat, kind="stable"):
            members = [int(v) for v in combos[i] if v]
            need = np.bincount(members)
            n = int(min([repeat[i], *(left[v] // need[v] for v in set(members))]))
            if n:
                take(members, n)
        # Rounding leaves pieces behind: exact pairs and windows among them still fill sequences.
        for a in range(size, -(-size // 2) - 1, -1):
            b = size - a
            n = int(left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b]))
            if n:
                take([a, b] if b else [a], n)
        self.firsts = first
        self.edges = [np.cumsum([n for _, n, _ in s]) if s else np.empty(0, np.int64) for s in slots]
        self.slots = [np.array(s, np.int64).reshape(-1, 3) for s in slots]
        lengths = np.arange(size + 1)
        # The stream of leftovers: longest first.
        before = np.cumsum((left * lengths)[::-1])[::-1]
        self.stream = np.append(before[1:], 0)

    def place(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """Parts of a piece: (place in the piece, length, sequence, offset)."""
        edges = self.edges[length]
        taken = int(edges[-1]) if len(edges) else 0
        if rank < taken:
            k = int(np.searchsorted(edges, rank, "right"))
            first, n, offset = self.slots[length][k]
            return [(0, length, int(first + rank - (edges[k] - n)), int(offset))]
        at = int(self.stream[length]) + (rank - taken) * length
        out, done = [], 0
        while done < length:
            sequence, offset = divmod(at + done, self.size)
            n = min(length - done, self.size - offset)
            out.append((done, n, self.firsts + sequence, offset))
            done += n
        return out


def id_type(path: str, end_id: int) -> str:
    """The narrowest type that holds every id."""
    return "<u2" if max(len(bpe.vocabulary(path).lengths) - 1, end_id) < 1 << 16 else "<u4"


def pieces(docs: DataFrame, path: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """Full windows and rest of every document, with the writing task and the piece's slot among its equals there."""

    width = id_type(path, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        used = np.zeros(size + 1, np.int64)
        names = ["doc_id", "start", "length", "doc_tokens", "part", "slot", "ids"]
        kinds = [pa.int64()] * 6 + [pa.binary()]
        for group, coded in bpe.groups(batches, "text", path):
            rows, held = [], 0
            for doc_id, ids in zip(group.column("doc_id").to_pylist(), coded, strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype(width)
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    rows.append((doc_id, start, len(piece), len(ids), part, int(used[len(piece)]), piece.tobytes()))
                    used[len(piece)] += 1
                held += len(ids)
                if held >= 300_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(run, PIECE)


def pack(docs: DataFrame, path: str, end_id: int = 0, size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, start in its document, length, doc_tokens, sequence_id, offset, ids (u32 binary)."""
    cut = stored(pieces(docs, path, end_id, size), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    by_length = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most `size` rows
    histogram = np.zeros(size + 1, np.int64)
    for r in by_length:
        histogram[r.length] = r.n
    plan = Plan(histogram, size)
    # One row per task and length: how many pieces of that length earlier tasks have.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    width = id_type(path, end_id)
    ranked = cut.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("slot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split(" ")[0] for c in PACKED.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                group = batch.slice(at, 500)
                rows = []
                for doc_id, start, length, total, rank, ids in zip(*(group.column(c).to_pylist() for c in ("doc_id", "start", "length", "doc_tokens", "rank", "ids")), strict=True):
                    wide = np.frombuffer(ids, width).astype("<u4")
                    for done, n, sequence, offset in plan.place(length, rank):
                        rows.append((doc_id, start + done, n, total, sequence, offset, wide[done : done + n].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return ranked.select("doc_id", "start", "length", "doc_tokens", "rank", "ids").mapInArrow(run, PACKED)
