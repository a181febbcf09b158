"""Language-model scores by a probabilistic suffix tree.

Symbols are the bytes of a text's lower-cased words joined by single spaces, and one end symbol. The tree's states are
contexts of up to ``DEPTH`` symbols. A context is retained if its next-symbol counts diverge from those of its parent
(the context without its farthest symbol) by at least ``ln(N) / 2`` nats for each follower it adds, the price of a
parameter at ``N`` training symbols; the suffixes of a retained context are retained with it. A state's distribution is
smoothed towards its parent's with as much weight as it has different followers. A symbol is scored in the longest
suffix that is a state.

Counts cover all training rows: tasks count their own (context, symbol) keys and words, and the rest is aggregation. The
tree grows with them. Its most frequent states, up to ``TRANSITIONS`` rows, go to every task; those are closed under
suffixes. Only symbols whose state there has a longer one elsewhere are looked up in a table of all other states, by joins
of their distinct keys. A key holds all symbols of a context (48 bits), nothing is hashed there.

Words (for the plain unigram score beside it) are unbounded: the counts of the ``FREQUENT`` most frequent ones go to every
task, all others are looked up by a join on a 64-bit hash. Frequent words are thus never a hot key of the join.

Null and empty texts are the end symbol alone. Without training rows every symbol is equally likely. Repeated rows are
scored each; other columns are left out.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .batches import slices, stored, texts
from .minhash import span_hashes

DEPTH = 5
LEAST_COUNT = 8
TRANSITIONS = 2_000_000
FREQUENT = 50_000
PAD, SPACE, END = 0x09, 0x20, 0x0A  # white space other than the joining space cannot occur in words
HELD_KEYS = 3_000_000
END_WORD = -0x0A


def sequences(group: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each after ``DEPTH`` pads and before its end, and where each text's first symbol lies."""
    pad = bytes([PAD]) * DEPTH
    parts = [pad + b" ".join(t.encode("utf-8", "surrogatepass").lower().split()) + b"\n" for t in group]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(sizes) - sizes + DEPTH


def keys(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) key of every symbol, nearest context symbol first above the symbol; and each text's symbols."""
    wide = data.astype(np.uint64)
    key = wide[DEPTH:].copy()
    for k in range(1, DEPTH + 1):
        key |= wide[DEPTH - k : len(data) - k] << np.uint64(8 * k)
    counts = np.diff(np.append(starts, len(data) + DEPTH)) - DEPTH
    real = np.ones(len(key), bool)
    for shift in range(1, DEPTH + 1):
        real[starts[1:] - DEPTH - shift] = False
    return key[real], counts


def word_hashes(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, and the number of words of each text."""
    stops = np.flatnonzero((data == SPACE) | (data == END))
    lo = np.empty(len(stops), np.int64)
    lo[1:] = stops[:-1] + 1
    ends = data[stops] == END
    first = np.append(True, ends[:-1])
    lo[first] = starts
    some = stops > lo  # an empty text has its end right at its start
    owner = np.cumsum(first) - 1
    counts = np.bincount(owner[some], minlength=len(starts))
    return span_hashes(data, lo[some], stops[some]).view(np.int64), counts


def _sum(key: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    coded = pa.array(np.concatenate(key)).dictionary_encode()
    return coded.dictionary.to_numpy(), np.bincount(coded.indices.to_numpy(), weights=np.concatenate(n), minlength=len(coded.dictionary)).astype(np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """Counts of words (kind 0) and of (context, symbol) keys (kind 1) over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {0: ([], []), 1: ([], [])}

        def rows(kind: int) -> pa.RecordBatch:
            key, n = _sum(*held[kind])
            held[kind] = ([], [])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.astype(np.int64)), pa.array(n)], ["kind", "key", "n"])

        for part in slices(batches, "text"):
            data, starts = sequences(texts(part, "text"))
            key, _ = keys(data, starts)
            word, _ = word_hashes(data, starts)
            for kind, values in ((0, np.append(word, np.full(len(starts), END_WORD))), (1, key.astype(np.int64))):
                k, n = _sum([values], [np.ones(len(values), np.int64)])
                held[kind][0].append(k)
                held[kind][1].append(n)
                if sum(map(len, held[kind][0])) > HELD_KEYS:
                    k, n = _sum(*held[kind])
                    held[kind] = ([k], [n])
                    if len(k) > HELD_KEYS // 2:
                        yield rows(kind)
        for kind in (0, 1):
            if held[kind][0]:
                yield rows(kind)

    return docs.select("text").mapInArrow(run, "kind int, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def levels(counts: DataFrame) -> DataFrame:
    """Counts of every context length: k, key, n, and the context's total and number of followers."""
    spread = counts.where("kind = 1").select(F.explode(F.array(*(F.lit(i) for i in range(DEPTH + 1)))).alias("k"), "key", "n")
    summed = spread.groupBy("k", F.col("key").bitwiseAND(F.expr("shiftleft(1L, (k + 1) * 8) - 1")).alias("key")).agg(F.sum("n").alias("n"))
    one = Window.partitionBy("k", "context")  # a context has at most 256 followers
    return summed.withColumn("context", F.shiftright("key", 8)).select("*", F.sum("n").over(one).alias("total"), F.count("*").over(one).alias("followers"))


def divergences(level: DataFrame) -> DataFrame:
    """Nats by which each context's counts diverge from its parent's distribution: k, context, gain, followers, total."""
    parent = level.select((F.col("k") + 1).alias("k"), F.col("key").alias("parent_key"), F.col("n").alias("parent_n"), F.col("total").alias("parent_total"))
    child = level.where("k > 0").withColumn("parent_key", F.col("key").bitwiseAND(F.expr("shiftleft(1L, k * 8) - 1")))
    gain = F.sum(F.col("n") * F.log(F.col("n") * F.col("parent_total") / (F.col("total") * F.col("parent_n"))))
    return child.join(parent, ["k", "parent_key"]).groupBy("k", "context").agg(gain.alias("gain"), F.max("followers").alias("followers"), F.max("total").alias("total"))


def retained(level: DataFrame, symbols: int, least_count: int = LEAST_COUNT) -> DataFrame:
    """Rows of ``level`` that belong to states: contexts that pass the test, their suffixes, and the root."""
    tested = stored(divergences(level).where(F.col("total") >= least_count), "divergences")
    price = math.log(max(2, symbols)) / 2
    passing = tested.where(F.col("gain") >= price * F.col("followers"))
    suffixes = passing.select(F.explode(F.sequence(F.lit(1), "k")).alias("j"), "context").select(F.col("j").alias("k"), F.col("context").bitwiseAND(F.expr("shiftleft(1L, j * 8) - 1")).alias("context")).distinct()
    return stored(level.join(suffixes, ["k", "context"], "left_semi").unionByName(level.where("k = 0")).select("k", "key", "n", "total", "followers"), "tree")


def parted(rows: DataFrame, transitions: int) -> tuple[DataFrame, DataFrame | None]:
    """The states that go to tasks, with ``more``: whether a longer one is elsewhere; and all others with their logs."""
    if rows.count() <= transitions:
        return rows.withColumn("more", F.lit(False)), None
    least = 2
    # A context occurs at most as often as its suffixes, so any bound leaves a part that is closed under suffixes.
    while rows.where((F.col("total") >= least) & (F.col("k") > 0)).count() > transitions:
        least *= 2
    near = (F.col("total") >= least) | (F.col("k") == 0)
    above = rows.where("k = 0").select("k", "key", ((F.col("n") + F.col("followers") / 256) / (F.col("total") + F.col("followers"))).alias("p"))
    parts = []
    for depth in range(1, DEPTH + 1):
        below = above.select(F.col("key").alias("parent_key"), F.col("p").alias("parent_p"))
        own = rows.where(F.col("k") == depth).withColumn("parent_key", F.col("key").bitwiseAND(F.lit((1 << 8 * depth) - 1)))
        own = own.join(below, "parent_key").withColumn("p", (F.col("n") + F.col("followers") * F.col("parent_p")) / (F.col("total") + F.col("followers")))
        above = stored(own.select("k", "key", "p", "total", "followers"), "priced")
        parts.append(above.where(~near).select("k", "key", F.log10("p").alias("log"), F.log10(F.col("followers") / (F.col("total") + F.col("followers"))).alias("back")))
    rest = stored(functools.reduce(DataFrame.unionByName, parts), "rest")
    context = F.shiftright("key", 8)
    longer = rest.select((F.col("k") - 1).alias("k"), context.bitwiseAND(F.expr("shiftleft(1L, (k - 1) * 8) - 1")).alias("context")).distinct()
    top = rows.where(near).withColumn("context", context).join(longer.withColumn("more", F.lit(True)), ["k", "context"], "left")
    return top.drop("context").withColumn("more", F.coalesce("more", F.lit(False))), rest


def looked_up(asked: DataFrame, rest: DataFrame) -> DataFrame:
    """key, log of every ``asked (key, base, depth)``: its symbol in the longest state, from its score ``base`` at ``depth``."""
    each = asked.select("key", "base", F.explode(F.sequence(F.col("depth") + 1, F.lit(DEPTH))).alias("k"))
    each = each.withColumn("own", F.col("key").bitwiseAND(F.expr("shiftleft(1L, (k + 1) * 8) - 1"))).withColumn("context", F.shiftright("own", 8))
    states = rest.select("k", F.shiftright("key", 8).alias("context"), "back").distinct()
    # What follows a context follows its suffixes, so the states that lack a symbol are the longest ones.
    found = each.join(states, ["k", "context"]).join(rest.select("k", F.col("key").alias("own"), "log"), ["k", "own"], "left")
    found = found.groupBy("key").agg(F.max_by("log", F.when(F.col("log").isNotNull(), F.col("k"))).alias("log"), F.sum(F.when(F.col("log").isNull(), F.col("back"))).alias("back"))
    return asked.join(found, "key", "left").select("key", (F.coalesce("log", "base") + F.coalesce("back", F.lit(0.0))).alias("log"))


class Tree:
    """States and smoothed log10 probabilities, as sorted arrays per context length. ``rest`` has the states that are not here."""

    rest: DataFrame | None = None

    def __init__(self, levels: Iterable[tuple[np.ndarray, ...]]):
        """``levels`` gives key, n, total, followers and more of the rows of each context length, from 0 on; one is held at a time."""
        self.root = np.full(256, 1 / 256)
        self.more: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self.logs: list[np.ndarray] = []
        self.states: list[np.ndarray] = []
        self.back: list[np.ndarray] = []
        above_keys, above = np.arange(256, dtype=np.int64), self.root
        for depth, (own, n, total, followers, more) in enumerate(levels):
            if not depth:
                self.more.append(more[:1] if len(more) else np.zeros(1, bool))
                if len(own):
                    c, f = float(total[0]), float(followers[0])
                    self.root *= f / (c + f)
                    self.root[own] += n / (c + f)
                continue
            at = np.argsort(own, kind="stable")
            own, c, f = own[at], total[at].astype(float), followers[at].astype(float)
            p = (n[at] + f * above[np.searchsorted(above_keys, own & ((1 << 8 * depth) - 1))]) / (c + f)
            context, first = np.unique(own >> 8, return_index=True)
            self.keys.append(own)
            self.logs.append(np.log10(p))
            self.states.append(context)
            self.back.append(np.log10(f[first] / (c[first] + f[first])))
            self.more.append(more[at][first])
            above_keys, above = own, p
        self.root = np.log10(self.root)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rest"}

    def score(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of each key's symbol in the longest suffix of its context that is a state here."""
        return self.walk(key)[0]

    def walk(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores, lengths of the states they come from, and whether a longer state is elsewhere."""
        key = key.astype(np.int64)
        out = self.root[key & 255]
        deep, more = np.zeros(len(key), np.int32), np.full(len(key), self.more[0][0])
        live = np.arange(len(key))
        for depth in range(1, DEPTH + 1):
            own = key[live] & ((1 << 8 * (depth + 1)) - 1)
            states = self.states[depth - 1]
            if not len(states) or not len(live):
                break
            at = np.minimum(np.searchsorted(states, own >> 8), len(states) - 1)
            here = states[at] == own >> 8
            live, own, at = live[here], own[here], at[here]
            place = np.minimum(np.searchsorted(self.keys[depth - 1], own), len(self.keys[depth - 1]) - 1)
            seen = self.keys[depth - 1][place] == own
            out[live] = np.where(seen, self.logs[depth - 1][place], self.back[depth - 1][at] + out[live])
            deep[live], more[live] = depth, self.more[depth][at]
        return out, deep, more


def train(docs: DataFrame, transitions: int = TRANSITIONS) -> tuple[DataFrame, Tree, int, int]:
    """Word counts (key, n), the tree, the number of training tokens and of different ones, from all rows."""
    counts = stored(counted(docs), "counts")
    words = counts.where("kind = 0").select("key", "n")
    sizes = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    by_kind = {r.kind: (r.n, r.v) for r in sizes}
    tokens, different = by_kind.get(0, (0, 0))
    level = stored(levels(counts), "levels")
    top, rest = parted(retained(level, by_kind.get(1, (0, 0))[0]), transitions)
    tree = Tree(gathered(stored(top, "near")))
    tree.rest = rest
    return words, tree, tokens, different


def gathered(top: DataFrame) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of each context length, as Arrow: rows of Python objects would take ten times the memory. There are at most
    ``transitions`` rows and the root's."""
    for depth in range(DEPTH + 1):
        rows = top.where(F.col("k") == depth).select("key", "n", "total", F.col("followers").cast("int"), "more").toArrow()
        yield tuple(rows.column(c).to_numpy() for c in ("key", "n", "total", "followers", "more"))


def score(docs: DataFrame, trained: tuple[DataFrame, Tree, int, int], frequent: int = FREQUENT) -> DataFrame:
    """Per row: doc_id, n_tokens, n_known, base_score (unigram with 0.5 added), score (log10 probability in the tree)."""
    words, tree, tokens, different = trained
    spark = docs.sparkSession
    below = math.log10(tokens + 0.5 * (different + 1))
    top = words.orderBy(F.desc("n"), "key").limit(frequent).toPandas().sort_values("key")
    model = spark.sparkContext.broadcast((tree, top["key"].to_numpy(np.int64), top["n"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, top_keys, top_n = model.value
        top_log = np.log10(top_n + 0.5) - below
        for part in slices(batches, "text"):
            data, starts = sequences(texts(part, "text"))
            key, counts = keys(data, starts)
            coded = pa.array(key).dictionary_encode()
            logs, _, more = tree.walk(coded.dictionary.to_numpy())
            places = coded.indices.to_numpy()
            scores = np.add.reduceat(np.where(more, 0.0, logs)[places], np.cumsum(counts) - counts)
            far = more[places]
            far_pair, far_times = np.unique(np.stack([np.repeat(np.arange(len(starts)), counts)[far], key[far].astype(np.int64)]), axis=1, return_counts=True) if far.any() else (np.empty((2, 0), np.int64), np.empty(0, np.int64))
            hashes, n_words = word_hashes(data, starts)
            owner = np.append(np.repeat(np.arange(len(starts)), n_words), np.arange(len(starts)))
            hashes = np.append(hashes, np.full(len(starts), END_WORD))
            base, known = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
            if len(top_keys):
                at = np.minimum(np.searchsorted(top_keys, hashes), len(top_keys) - 1)
                hit = top_keys[at] == hashes
                base += np.bincount(owner[hit], weights=top_log[at[hit]], minlength=len(starts))
                known += np.bincount(owner[hit], minlength=len(starts))
                owner, hashes = owner[~hit], hashes[~hit]
            order = np.lexsort((hashes, owner))
            owner, hashes = owner[order], hashes[order]
            new = np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])) if len(owner) else np.empty(0, bool)
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(owner)))
            kind = np.append(np.zeros(len(starts) + len(first), np.int32), np.ones(len(far_times), np.int32))
            owner, hashes, times = np.append(owner[first], far_pair[0]), np.append(hashes[first], far_pair[1]), np.append(times, far_times)
            uid = part.column("uid").to_numpy()
            m, n = len(owner), len(starts)
            empty = lambda t: pa.nulls(m, t)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.append(uid, uid[owner])), pa.concat_arrays([part.column("doc_id"), empty(pa.int64())]),
                    pa.concat_arrays([pa.array(n_words + 1), empty(pa.int64())]), pa.concat_arrays([pa.array(scores), empty(pa.float64())]),
                    pa.concat_arrays([pa.array(base), empty(pa.float64())]), pa.concat_arrays([pa.array(known), empty(pa.int64())]),
                    # A text's own row looks up nothing: its key only spreads these rows.
                    pa.array(np.append(uid * np.int64(0x9E3779B97F4A7C1), hashes)), pa.array(np.append(np.zeros(n, np.int64), times)), pa.array(kind),
                ],
                ["uid", "doc_id", "n_tokens", "score", "base", "known", "key", "times", "kind"],
            )

    source = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), "text")
    rows = source.mapInArrow(run, "uid long, doc_id long, n_tokens long, score double, base double, known long, key long, times long, kind int")
    words = words.select("key", F.col("n").alias("c"))
    if tree.rest is None:
        looked = rows.join(words, "key", "left").withColumn("log", F.lit(0.0))
    else:

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = model.value[0]
            for part in slices(batches, "text"):
                key = np.unique(keys(*sequences(texts(part, "text")))[0])
                base, deep, more = tree.walk(key)
                yield pa.RecordBatch.from_arrays([pa.array(key[more].astype(np.int64)), pa.array(base[more]), pa.array(deep[more])], ["key", "base", "depth"])

        far = looked_up(stored(docs.select("text").mapInArrow(asked, "key long, base double, depth int").dropDuplicates(["key"]), "asked"), tree.rest)
        table = words.select("key", F.lit(0).alias("kind"), "c", F.lit(0.0).alias("log")).unionByName(far.select("key", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("c"), "log"))
        looked = rows.join(table, ["kind", "key"], "left")
    rare = F.when((F.col("times") > 0) & (F.col("kind") == 0), F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5)) - F.lit(below))).otherwise(F.lit(0.0))
    met = F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)
    return looked.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"),
        (F.max("known") + F.sum(met)).alias("n_known"), (F.max("base") + F.sum(rare)).alias("base_score"), (F.max("score") + F.sum(F.when(F.col("kind") == 1, F.col("times") * F.col("log")).otherwise(0.0))).alias("score"),
    ).drop("uid")
