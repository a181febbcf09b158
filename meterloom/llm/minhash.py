"""Near-duplicates by a chosen-path set similarity join.

Documents are sets of word shingles. Equal sets are one from the start. Every set walks down independent trees: at the
root of tree ``t`` it goes to the node of its ``t``-th minwise token; at a node it goes on to the nodes of ``BRANCHES``
further minwise tokens that the node picks for all its members. Two sets share such a step with the probability of their
similarity. A node with up to ``LEAF_PAIRS`` pairs that are not yet of one component (and up to ``LEAF_ROWS`` sets) is
compared exhaustively, by sketches of ``BINS`` bytes. A larger one is only compared with one of its members (its pivot)
and branched. ``ROOTS`` trees leave a link at the threshold unseen with a probability of about
``(1 - 0.75) ** ROOTS`` if its nodes are leaves, and BRANCHES of 2 lose about 6 % of it per further level and tree.

Of a leaf's likely pairs those go first that span it, fewer than it has members, so a group of near copies costs as many
pairs as it has members. Where one of them proves to be no link, the members that still have a likely partner in another
component come together once more with their full sets, in blocks of up to ``BLOCK_SHINGLES``: shared shingles are counted
there, all pairs are decided in place, and only links that span the block leave it.

Found pairs pass three checks: sizes, agreement of the sketches (a link at the threshold fails it once in about 300,000
cases), and the similarity of the full sets, which alone decides. Links are joined to components after the first pivots
and after each level, and nodes whose members are all of one component are done: a large group of copies is settled by
its pivots and never compared pair by pair. Nodes that are still large and mixed after ``LEVELS`` levels are compared
exhaustively in blocks, so nothing is dropped.

Null and empty texts have no shingles and link with nothing. Null ids do not count as the smallest id of a component.
Repeated rows are copies. Other columns are left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batches import binary_column, ranges, slices, small_batches, stored, texts
from .components import components

WORDS = 5
SLOTS = 32
ROOTS = 16
BRANCHES = 2
LEAF_PAIRS = 1_000_000
LEAF_ROWS = 20_000
BLOCK = 128
NEAREST = 3
LEVELS = 8
BINS = 512
PIECE_BYTES = 2_000_000
#: Shingles of the sets that are held as one block; a task holds two blocks at a time.
BLOCK_SHINGLES = 1_000_000
#: Pairs that are compared at once, without a look at the nearest ones first.
FEW_PAIRS = 10_000
#: Rows of (uid, doc_id, hash) that are broadcast to find their texts; more of them are joined by a shuffle, which most
#: other texts do not enter: 64 bits for each of FILTER_WORDS words tell them apart before.
BROADCAST_ROWS = 10_000
FILTER_WORDS = 1 << 18
_SEED = 0x5EED


@functools.lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    rng = np.random.default_rng(_SEED)
    table = rng.integers(0, 1 << 64, 256, np.uint64)
    xors = rng.integers(0, 1 << 32, SLOTS, np.uint64).astype(np.uint32)
    factors = rng.integers(0, 1 << 32, SLOTS, np.uint64).astype(np.uint32) | np.uint32(1)
    return table, xors, factors, int(rng.integers(0, 1 << 63, dtype=np.int64)) | 1


class Powers:
    """Powers of an odd factor and of its inverse modulo 2^64, as far as asked so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            factor = _constants()[3]
            size = 1 << max(12, (n - 1).bit_length())
            with np.errstate(over="ignore"):
                self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, f, np.uint64)])) for f in (factor, pow(factor, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def span_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``lo`` to ``hi`` (both ascending).

    A hash is a difference of prefix sums of byte codes times powers of a factor, shifted to its own start. Long data goes
    in pieces, so the sums stay small.
    """
    table = _constants()[0]
    out = np.empty(len(lo), np.uint64)
    at = 0
    while at < len(lo):
        upto = max(at + 1, int(np.searchsorted(hi, lo[at] + PIECE_BYTES, "right")))
        base, end = int(lo[at]), int(hi[upto - 1])
        up, down = _POWERS.upto(end - base + 1)
        sums = np.zeros(end - base + 1, np.uint64)
        np.cumsum(table[data[base:end]] * up[: end - base], out=sums[1:])
        a, b = lo[at:upto] - base, hi[at:upto] - base
        out[at:upto] = (sums[b] - sums[a]) * down[a]
        at = upto
    return _mix(out)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; with fewer words, of all its words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    data = np.frombuffer(b" ".join(words) + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(WORDS, len(ends))
    return np.unique(span_hashes(data, starts[: len(ends) - k + 1], ends[k - 1 :]))


def signature(hashes: np.ndarray) -> np.ndarray:
    """Smallest value of each of ``SLOTS`` rearrangements of the hashes."""
    _, xors, factors, _ = _constants()
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(SLOTS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 4096):
        part = low[at : at + 4096]
        np.minimum(out, ((part[None, :] ^ xors[:, None]) * factors[:, None]).min(axis=1), out=out)
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """One byte for each of ``BINS`` ranges of hash values: some bits of the smallest hash there, 0 where there is none."""
    edges = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1))
    at = np.searchsorted(hashes, edges)
    after = np.append(at[1:], len(hashes))
    out = np.zeros(BINS, np.uint8)
    some = after > at
    out[some] = (hashes[at[some]] % np.uint64(255)).astype(np.uint8) + 1
    return out


def likely(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two sketch matrices that may reach the threshold (within 4.5 standard errors of it), and all estimates.

    ``n`` is the sum of both set sizes. The bins show a sample of the union, which at the threshold has ``n / 1.75``
    members; the smaller the sets, the more of them it shows, and the smaller is the error.
    """
    told = BINS - ((x | y) == 0).sum(axis=1)
    agree = ((x == y) & (x > 0)).sum(axis=1)
    unseen = np.clip(1 - told / np.maximum(n / 1.75, 1), 0.05, 1)
    return agree >= 0.75 * told - 4.5 * np.sqrt(0.1875 * told * unseen) - 1, agree / np.maximum(told, 1)


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that tell sets apart."""
    a = int(_mix(hashes ^ np.uint64(0x9E3779B97F4A7C15)).sum()) if len(hashes) else 0
    b = int((hashes * np.uint64(0xD6E8FEB86659FD93) ^ (hashes >> np.uint64(29))).sum()) if len(hashes) else 0
    return a - (1 << 63), b - (1 << 63)


def prepared(docs: DataFrame) -> DataFrame:
    """One row per document: uid, doc_id, hash of the text, key of the set, its size, minwise tokens and sketch."""
    schema = "uid long, doc_id long, text_hash long, k1 long, k2 long, n long, sig array<int>, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            sets = [shingles(t) for t in texts(part, "text")]
            k1, k2 = zip(*map(set_key, sets), strict=True)
            sig = np.concatenate([signature(s) for s in sets]).view(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("uid"), part.column("doc_id"), part.column("text_hash"), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * SLOTS, pa.int32()), pa.array(sig)), binary_column([sketch(x) for x in sets])],
                ["uid", "doc_id", "text_hash", "k1", "k2", "n", "sig", "sketch"],
            )

    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")
    return source.mapInArrow(run, schema)


def _mixed(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Members of nodes that hold two components or more, with the node's pivot, whether it is a leaf, and their own component."""
    if labels is None:
        named = members.withColumn("own", F.col("uid"))
    else:
        named = members.join(labels.select(F.col("node").alias("uid"), "component"), "uid", "left").select("node", "uid", F.coalesce("component", "uid").alias("own"))
    parts = named.groupBy("node", "own").agg(F.count("*").alias("size"), F.min("uid").alias("pivot"))
    sizes = parts.groupBy("node").agg(F.sum("size").alias("size"), F.min("pivot").alias("pivot"), ((F.pow(F.sum("size"), 2) - F.sum(F.pow("size", 2))) / 2).alias("cross"))
    small = (F.col("cross") <= LEAF_PAIRS) & (F.col("size") <= LEAF_ROWS)
    return named.join(sizes.where("cross > 0").withColumn("small", small).drop("cross", "size"), "node")


def _starred(live: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs of each member with its node's pivot whose sizes and sketches allow the threshold."""
    pairs = live.where("uid != pivot").select(F.col("pivot").alias("a"), F.col("uid").alias("b")).distinct()
    with_a = pairs.join(reps.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sketch_a")), "a")
    with_b = with_a.join(reps.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sketch_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("sketch_a", "sketch_b"))
            hit, share = likely(x, y, batch.column("na").to_numpy() + batch.column("nb").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(share)], ["a", "b", "share"]).filter(pa.array(hit))

    return with_b.where(100 * F.least("na", "nb") >= 75 * F.greatest("na", "nb")).select("a", "b", "na", "nb", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long, share double")


def _likely_pairs(own: np.ndarray, n: np.ndarray, sig: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and shares of a node's likely pairs, a strip of BLOCK members against all later ones at a time."""
    for at in range(0, len(n), BLOCK):
        strip = [], [], []
        for other in range(at, len(n), BLOCK):
            i, j = slice(at, at + BLOCK), slice(other, other + BLOCK)
            ok = (own[i, None] != own[None, j]) & (100 * np.minimum(n[i, None], n[None, j]) >= 75 * np.maximum(n[i, None], n[None, j]))
            if at == other:
                ok = np.triu(ok, 1)
            x, y = np.nonzero(ok)
            x, y = x + at, y + other
            for k in range(0, len(x), 8_000):
                a, b = x[k : k + 8_000], y[k : k + 8_000]
                hit, share = likely(sig[a], sig[b], n[a] + n[b])
                for part, found in zip(strip, (a, b, share), strict=True):
                    part.append(found[hit])
        if strip[0] and sum(map(len, strip[0])):
            yield tuple(np.concatenate(part) for part in strip)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Each node with uid, own, n and sketch of its members, from rows in the order of nodes."""
    held: list[tuple[np.ndarray, ...]] = []

    def whole_node() -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return int(held[0][0][0]), *(np.concatenate(c) for c in list(zip(*held, strict=True))[1:])

    for whole in batches:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            node = batch.column("node").to_numpy()
            columns = [batch.column(c).to_numpy() for c in ("uid", "own", "n")]
            columns.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, BINS))
            edges = [0, *(np.flatnonzero(node[1:] != node[:-1]) + 1).tolist(), len(node)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if held and held[0][0][0] != node[lo]:
                    yield whole_node()
                    held = []
                held.append((node[lo:hi], *(c[lo:hi] for c in columns)))
    if held:
        yield whole_node()


def _met(live: DataFrame, reps: DataFrame) -> DataFrame:
    """Members with their sketches, those of a node in one task."""
    full = live.select("node", "uid", "own").join(reps.select("uid", "n", "sketch"), "uid").repartition("node").sortWithinPartitions("node", "uid")
    return full.select("node", "uid", "own", "n", "sketch")


class _Groups:
    """Groups that links join to larger ones."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, g: int) -> int:
        parent = self.parent
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    def join(self, g: int, h: int) -> bool:
        """Whether they were apart."""
        g, h = self.root(g), self.root(h)
        self.parent[g] = h
        return g != h


def _compared(live: DataFrame, reps: DataFrame, spanning: bool) -> DataFrame:
    """Pairs (a, b, share) of different components inside each node, whose sizes and sketches allow the threshold.

    A node's members come together in one task, where their sketches are compared in blocks; only likely pairs leave it. With
    ``spanning``, of those the most alike that still join two groups of the node, fewer than it has members; nodes that keep
    other likely pairs back are named in rows of their own (node), to be compared again if these pairs leave them mixed.
    """
    names = ["a", "b", "share", "node"]

    def near(node: int, uid: np.ndarray, own: np.ndarray, n: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        nothing = lambda count: pa.nulls(count, pa.int64())
        group, kept_back = np.unique(own, return_inverse=True)[1].tolist(), False
        groups = _Groups(max(group) + 1)
        for a, b, share in _likely_pairs(own, n, sig):
            if spanning:
                chosen = [k for k in np.argsort(-share, kind="stable").tolist() if groups.join(group[a[k]], group[b[k]])]
                kept_back |= len(chosen) < len(a)
                a, b, share = a[chosen], b[chosen], share[chosen]
            yield pa.RecordBatch.from_arrays([pa.array(uid[a]), pa.array(uid[b]), pa.array(share), nothing(len(a))], names)
        if kept_back:
            yield pa.RecordBatch.from_arrays([nothing(1), nothing(1), pa.nulls(1, pa.float64()), pa.array([node])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in _nodes(batches):
            yield from near(*found)

    return _met(live, reps).mapInArrow(run, "a long, b long, share double, node long")


def _undecided(live: DataFrame, reps: DataFrame) -> DataFrame:
    """Members of nodes that have a likely partner of another component there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, uid, own, n, sig in _nodes(batches):
            some = np.zeros(len(uid), bool)
            for a, b, _ in _likely_pairs(own, n, sig):
                some[a] = some[b] = True
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), node)), *(pa.array(c[some]) for c in (uid, own, n))], ["node", "uid", "own", "n"])

    return _met(live, reps).mapInArrow(run, "node long, uid long, own long, n long")


def spanning_links(own: np.ndarray, block: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that join all groups (``own``) which any link joins, fewer than there are sets.

    Decides on the full sets, by counts of shared shingles from an index of the sets that hold each. With two blocks, only
    pairs of both are looked at. Sets of the largest group meet only others, so the work is that of the pairs apart.
    """
    n = np.array([len(s) for s in sets])
    hashes = np.concatenate(sets)
    order = np.argsort(hashes, kind="stable").astype(np.int32)
    hashes = hashes[order]
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    del hashes
    first = np.flatnonzero(new)
    held = np.diff(first, append=len(new))
    token = np.empty(len(new), np.int32)
    token[order] = np.cumsum(new, dtype=np.int32) - 1
    holders = np.repeat(np.arange(len(sets), dtype=np.int32), n)[order]
    start = np.cumsum(n) - n
    del order, new
    group, sizes = np.unique(own, return_inverse=True, return_counts=True)[1:]
    largest = group == sizes.argmax()
    groups, links, one_block = _Groups(len(sizes)), [], block.min() == block.max()
    seen = np.zeros(len(sets), bool)
    for i in np.flatnonzero(~largest).tolist():
        seen[i] = True
        own_tokens = token[start[i] : start[i] + n[i]]
        shared = np.bincount(holders[ranges(first[own_tokens], held[own_tokens])], minlength=len(sets))
        hit = (100 * shared >= 75 * (n[i] + n - shared)) & (group != group[i]) & ~seen
        if not one_block:
            hit &= block != block[i]
        places = np.flatnonzero(hit)
        for j in places[np.unique(group[places], return_index=True)[1]].tolist():
            if groups.join(group[i], group[j]):
                links.append((i, j))
    at = np.array(links, np.int64).reshape(-1, 2)
    return at[:, 0], at[:, 1]


def _decided(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) that span the members ``rows (node, uid, own, n)`` of each node. ``found`` has uid and text of all."""
    blocks = rows.groupBy("node").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "node").withColumn("block", F.pmod(F.xxhash64("uid"), "blocks").cast("int"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    each = each.select("node", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "uid", "own", "block")
    full = each.join(found, "uid").repartition("node", "lo", "hi").sortWithinPartitions("node", "lo", "hi", "uid")

    def links(members: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        uid, own, block = (np.array(c, np.int64) for c in list(zip(*members, strict=True))[:3])
        a, b = spanning_links(own, block, [m[3] for m in members])
        return pa.RecordBatch.from_arrays([pa.array(uid[a]), pa.array(uid[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, members = None, []
        for part in slices(batches, "text"):
            for node, lo, hi, uid, own, block, text in zip(*(part.column(c).to_pylist() for c in ("node", "lo", "hi", "uid", "own", "block", "text")), strict=True):
                if members and last != (node, lo, hi):
                    yield links(members)
                    members = []
                last = node, lo, hi
                members.append((uid, own, block, shingles(text)))
        if members:
            yield links(members)

    return full.select("node", "lo", "hi", "uid", "own", "block", "text").mapInArrow(run, "a long, b long")


def _texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """uid and text of ``wanted (uid, doc_id, text_hash)``."""
    source = docs.select(F.col("doc_id").cast("long").alias("source_id"), F.xxhash64("text").alias("text_hash"), "text")
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    else:
        source = _filtered(source, wanted, "text_hash")
    return source.join(wanted, (source["text_hash"] == wanted["text_hash"]) & source["source_id"].eqNullSafe(wanted["doc_id"])).select("uid", "text").dropDuplicates(["uid"])


def _filtered(source: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """Rows of ``source`` but most of those whose ``column`` is not among ``wanted``'s. The bits that tell have a fixed size."""
    word, bit = F.pmod(F.shiftright(F.xxhash64(column), 6), F.lit(FILTER_WORDS)), F.pmod(F.xxhash64(column), F.lit(64)).cast("int")
    bits = wanted.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    marked = source.withColumn("_word", word).join(F.broadcast(bits), "_word")
    return marked.where(F.call_function("shiftright", "_bits", bit).bitwiseAND(F.lit(1)) == 1).select(source.columns)


def _confirmed(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs whose full sets reach the threshold. ``found`` has uid and text of both."""
    full = pairs.join(found.select(F.col("uid").alias("a"), F.col("text").alias("text_a")), "a").join(found.select(F.col("uid").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}
        for part in slices(batches, "text_a"):
            keep = []
            for a, b, ta, tb in zip(*(part.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                if len(last) > 64:
                    last.clear()
                for uid, text in ((a, ta), (b, tb)):
                    if uid not in last:
                        last[uid] = shingles(text)
                x, y = last[a], last[b]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= 75 * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], ["a", "b"]).filter(pa.array(keep))

    return full.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def clusters(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept."""
    return _result(*_walked(docs))


def survivors(docs: DataFrame) -> DataFrame:
    """doc_id and text_hash of one document of each component: the least doc_id (null only if there is no other), then the
    least hash. Documents without words are each their own."""
    sets, firsts, labels = _walked(docs)
    rows = _named(sets, firsts, labels)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    chosen = rows.groupBy("component").agg(F.min(order).alias("_c")).select("_c.doc_id", "_c.text_hash")
    return chosen.unionByName(sets.where("n = 0").select("doc_id", "text_hash")).distinct()


def _walked(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All sets, the first row of each different one, and the components of those that have links."""
    with small_batches(docs.sparkSession):
        sets = stored(prepared(docs), "sets")
        firsts = sets.where("n > 0").groupBy("k1", "k2").agg(F.min("uid").alias("uid"))
        reps = stored(sets.join(firsts.select("uid"), "uid", "left_semi").select("uid", "doc_id", "text_hash", "n", "sig", "sketch"), "reps")
        roots = F.explode(F.transform(F.slice("sig", 1, ROOTS), lambda v, i: F.xxhash64(F.lit("root"), i, v)))
        members = reps.select(roots.alias("node"), "uid")
        walk = _Walk(docs, reps)
        # The first pivots settle groups of copies, so that the leaves need not compare them.
        walk.confirm(_starred(_mixed(members, None), reps))
        open_nodes = []
        for level in range(LEVELS + 1):
            live = stored(_mixed(members, walk.labels), "live")
            if live.isEmpty():
                break
            small, large = live.where("small"), live.where("not small")
            branching = not large.isEmpty()
            leaves = small if level < LEVELS else live
            # Fewer sets take part in what follows the first level's leaves; the sketches of the others stay out of its shuffles.
            compared = stored(_compared(leaves, _filtered(reps, live, "uid") if level else reps, True), "compared")
            pairs = compared.where("a is not null").drop("node")
            if branching:
                pairs = pairs.unionByName(_starred(large, _filtered(reps, large, "uid")))
            walk.confirm(pairs.distinct())
            # Nodes that kept pairs back are looked at again after all levels, if nothing has joined them by then.
            open_nodes.append(leaves.select("node", "uid").join(compared.where("node is not null").select("node"), "node", "left_semi"))
            if not branching:
                break
            # Large nodes that still hold several components go one level down.
            large = _mixed(large.select("node", "uid"), walk.labels).select("node", "uid")
            members = stored(large.join(reps.select("uid", "sig"), "uid").select("uid", F.explode(_branches()).alias("node")).distinct(), "members")
        if open_nodes:
            _left_apart(functools.reduce(DataFrame.unionByName, open_nodes), walk)
        return sets, firsts, walk.labels


def _left_apart(nodes: DataFrame, walk: _Walk) -> None:
    """Decide all pairs of what is still apart in nodes whose spanning pairs have been confirmed or refused."""
    live = stored(_mixed(nodes, walk.labels), "apart")
    if live.isEmpty():
        return
    rows = stored(_undecided(live, _filtered(walk.reps, live, "uid")), "undecided")
    if rows.isEmpty():
        return
    walk.fetch(rows.select("uid").distinct())
    walk.join(stored(_decided(rows, walk.found), "links"))


class _Walk:
    """Components so far, pairs that were compared, and the texts read for them."""

    def __init__(self, docs: DataFrame, reps: DataFrame):
        self.docs, self.reps = docs, reps
        self.labels = self.tested = self.found = None

    def confirm(self, pairs: DataFrame) -> None:
        """Compare the full sets of new pairs and join their links to the components."""
        if self.tested is not None:
            pairs = pairs.join(self.tested, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            self.labels = self.labels if self.labels is not None else components(pairs)
            return
        self.tested = pairs.select("a", "b") if self.tested is None else self.tested.unionByName(pairs.select("a", "b"))
        if pairs.count() <= FEW_PAIRS:
            self._link(pairs.select("a", "b"))
            return
        # The nearest partners of each set come first; most other pairs are then of one component and need no look.
        best = [F.row_number().over(Window.partitionBy(c).orderBy(F.desc("share"), o)) <= NEAREST for c, o in (("a", "b"), ("b", "a"))]
        ranked = pairs.select("a", "b", best[0].alias("near_a"), best[1].alias("near_b"))
        first = stored(ranked.where("near_a or near_b").select("a", "b"), "nearest")
        self._link(first)
        names = self.labels
        rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti")
        for c in ("a", "b"):
            rest = rest.join(names.select(F.col("node").alias(c), F.col("component").alias(f"own_{c}")), c, "left")
        rest = stored(rest.where("coalesce(own_a, a) != coalesce(own_b, b)").select("a", "b"), "rest")
        if not rest.isEmpty():
            self._link(rest)

    def _link(self, pairs: DataFrame) -> None:
        self.fetch(pairs.select(F.col("a").alias("uid")).union(pairs.select("b")).distinct())
        self.join(stored(_confirmed(pairs, self.found), "links"))

    def fetch(self, wanted: DataFrame) -> None:
        """Read the texts of ``wanted (uid)`` that are not there yet."""
        if self.found is not None:
            wanted = wanted.join(self.found.select("uid"), "uid", "left_anti")
        wanted = stored(self.reps.select("uid", "doc_id", "text_hash").join(wanted, "uid"), "wanted")
        if self.found is not None and wanted.isEmpty():
            return
        more = stored(_texts(wanted, self.docs), "texts")
        self.found = more if self.found is None else self.found.unionByName(more)

    def join(self, links: DataFrame) -> None:
        """Join the components of new links."""
        if self.labels is not None:
            if links.isEmpty():
                return
            links = links.unionByName(self.labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        self.labels = components(links)


def _branches() -> Column:
    """Nodes that a member of ``node`` goes on to: the node picks the slots, the member's tokens there name the nodes."""
    each = []
    for k in range(BRANCHES):
        slot = (ROOTS + F.pmod(F.xxhash64(F.col("node"), F.lit(k)), F.lit(SLOTS - ROOTS))).cast("int")
        each.append(F.xxhash64(F.col("node"), slot, F.element_at("sig", slot + 1)))
    return F.array(*each)


def _named(sets: DataFrame, firsts: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with words, with its component."""
    named = firsts.join(labels, firsts["uid"] == labels["node"], "left").select("k1", "k2", F.coalesce("component", "uid").alias("component"))
    return sets.where("n > 0").select("doc_id", "text_hash", "n", "k1", "k2").join(named, ["k1", "k2"])


def _result(sets: DataFrame, firsts: DataFrame, labels: DataFrame) -> DataFrame:
    rows = _named(sets, firsts, labels)
    least = rows.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = rows.join(least, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
