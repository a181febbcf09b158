"""Byte-level BPE in batched merge rounds.

The symbols of many words lie in one flat array. A round looks up the rank of every adjacent pair by binary search over
the sorted pair keys, takes each word's lowest rank by a segmented minimum, and merges its places from left to right in
all words at once. Words without a mergeable pair leave the array. Words longer than ``LONG_WORD`` bytes would need as
many rounds as they have bytes, so they go through a heap of pairs instead (n log n, same order of merges).

Texts are cut at the spaces before words, which the pre-tokenizer never joins; the few texts whose white space runs
cross such a cut go through the pattern as a whole.

Nulls count as the empty text and give no ids. Repeated rows are encoded each.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import binary_column, ranges, slices

LONG_WORD = 400
ENCODED_CHARS = 1_200_000
# The pre-tokenizer pattern of byte-level BPE.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: a byte that prints stands for itself, the others follow from U+0100."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printing)]
    return {chr(b): b for b in printing} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Merge ranks and token bytes of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        to_byte = byte_symbols()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*ids.values(), *self.special.values()]) + 1
        pieces = [b""] * size
        for token, i in ids.items():
            pieces[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token.encode()
        self.byte_id = np.array([ids[c] for c, _ in sorted(to_byte.items(), key=lambda x: x[1])], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in merges], np.uint64)
        right = np.array([ids[b] for _, b in merges], np.uint64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        keys = left << np.uint64(32) | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        self.by_rank = made
        self.byte_pairs = self.rank(*(np.repeat(self.byte_id, 256), np.tile(self.byte_id, 256))).reshape(256, 256)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.pair = {(int(a), int(b)): r for r, (a, b) in enumerate(zip(left, right, strict=True))}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or the number of merges where there is none."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], len(self.keys))

    def merge_long(self, word: np.ndarray) -> np.ndarray:
        """One long word by a heap of (rank, place) over a linked list."""
        sym = self.byte_id[word].tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := self.pair.get((sym[i], sym[i + 1]))) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j], after[i] = int(self.by_rank[r]), False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (s := self.pair.get((sym[x], sym[y]))) is not None:
                    heapq.heappush(heap, (s, x, sym[x], sym[y]))
        return np.array([s for s, ok in zip(sym, alive, strict=True) if ok], np.int64)

    def merge(self, text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words as one array of bytes and their lengths: ids of all words in one array, and how many each word has."""
        begin = np.cumsum(lengths) - lengths
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(lengths > LONG_WORD):
            ids = self.merge_long(text[begin[i] : begin[i] + lengths[i]])
            found.append((np.array([i]), np.array([len(ids)]), ids))
        live = np.flatnonzero((lengths <= LONG_WORD) & (lengths > 0))
        raw = text if len(live) == len(lengths) else text[ranges(begin[live], lengths[live])]
        sym, sizes, none = self.byte_id[raw], lengths[live], len(self.keys)
        last = np.zeros(len(sym), bool)
        last[np.cumsum(sizes) - 1] = True  # the last symbol of a word has no right neighbour
        rank = np.full(len(sym), none, np.int64)
        rank[:-1] = np.where(last[:-1], none, self.byte_pairs[raw[:-1], raw[1:]]) if len(sym) > 1 else none
        while len(live):
            starts = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(rank, starts)
            done = low == none
            if done.any():
                found.append((live[done], sizes[done], sym[ranges(starts[done], sizes[done])]))
                keep = ~done
                at = ranges(starts[keep], sizes[keep])
                sym, rank, last, live, sizes, low = sym[at], rank[at], last[at], live[keep], sizes[keep], low[keep]
                if not len(live):
                    break
            places = np.flatnonzero(rank == np.repeat(low, sizes))
            if (np.diff(places) == 1).any():  # equal symbols in a row: every second place of a run merges
                head = np.ones(len(places), bool)
                head[1:] = np.diff(places) != 1
                first = np.maximum.accumulate(np.where(head, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - first) % 2 == 0]
            sym[places] = self.by_rank[rank[places]]
            last[places] = last[places + 1]
            keep = np.ones(len(sym), bool)
            keep[places + 1] = False
            sizes = np.add.reduceat(keep, np.cumsum(sizes) - sizes, dtype=np.int64)
            sym, rank, last = sym[keep], rank[keep], last[keep]
            made = places - np.arange(len(places))  # where the merged symbols lie now
            stale = np.concatenate([made, made[made > 0] - 1])
            open_ = ~last[stale]
            rank[stale] = none
            stale = stale[open_]
            rank[stale] = self.rank(sym[stale], sym[stale + 1])
        counts = np.zeros(len(lengths), np.int64)
        for which, n, _ in found:
            counts[which] = n
        out = np.empty(int(counts.sum()), np.int64)
        begin = np.cumsum(counts) - counts
        for which, n, ids in found:
            out[ranges(begin[which], n)] = ids
        return out, counts

    def decode(self, ids: np.ndarray) -> str:
        ids = ids.astype(np.int64)
        return self.bytes[ranges(self.starts[ids], self.lengths[ids])].tobytes().decode("utf-8", "replace")


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def raw_words(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 of words as one array, and their lengths."""
    coded = [w.encode("utf-8", "surrogatepass") for w in words]
    return np.frombuffer(b"".join(coded), np.uint8), np.fromiter(map(len, coded), np.int64, len(coded))


def encode_whole(vocab: Vocabulary, text: str) -> np.ndarray:
    """Ids of one text through the pattern, with the strings of special tokens as their ids."""
    found = []
    for part in vocab.split.split(text) if vocab.split else [text]:
        if part in vocab.special:
            found.append(np.array([vocab.special[part]], np.uint32))
        elif part:
            words = PATTERN.findall(part)
            known = {w: i for i, w in enumerate(dict.fromkeys(words))}
            ids, sizes = vocab.merge(*raw_words(list(known)))
            at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            found.append(ids[ranges((np.cumsum(sizes) - sizes)[at], sizes[at])].astype(np.uint32))
    return np.concatenate(found) if found else np.empty(0, np.uint32)


def encode_group(vocab: Vocabulary, column: pa.Array) -> list[np.ndarray]:
    """Ids of each text of a slice.

    Pieces between spaces are told apart once per slice (dictionary encoding), then the words of the different pieces,
    and only different words go through the merge rounds.
    """
    column = pc.fill_null(column, "")
    whole = np.zeros(len(column), bool)
    for token in vocab.special:
        whole |= pc.match_substring(column, token).to_numpy(zero_copy_only=False)
    parts = pc.split_pattern(column, " ")
    edges = parts.offsets.to_numpy().astype(np.int64)
    edges -= edges[0]
    coded = parts.flatten().dictionary_encode()
    code, pieces = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    # Chunks: every different piece after a space, then the different first pieces of texts, which follow none.
    first, at_first = np.unique(code[edges[:-1]], return_inverse=True)
    code[edges[:-1]] = len(pieces) + at_first
    letters = pc.match_substring_regex(pieces, r"^\p{L}+$").to_numpy(zero_copy_only=False)
    marked = pc.match_substring_regex(pieces, r"^\p{L}+[.,;:!?|]$").to_numpy(zero_copy_only=False)
    plain = pa.concat_arrays([pieces.filter(pa.array(letters)), pc.utf8_slice_codeunits(pieces.filter(pa.array(marked)), 0, -1)]).dictionary_encode()
    plain_word = plain.indices.to_numpy().astype(np.int64)
    spaced = pc.binary_join_element_wise(" ", plain.dictionary, "")
    offsets = np.frombuffer(spaced.buffers()[1], np.int32, len(spaced) + 1, spaced.offset * 4).astype(np.int64)
    text = np.frombuffer(spaced.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    rest = np.flatnonzero(~(letters | marked))
    others = [" " + p for p in pieces.take(pa.array(rest)).to_pylist()] + pieces.take(pa.array(first)).to_pylist()
    other_words = [PATTERN.findall(c) for c in others]
    marks = pc.utf8_slice_codeunits(pieces.filter(pa.array(marked)), -1).to_pylist()
    known: dict[str, int] = {}
    base = len(spaced)
    other_at = np.array([known.setdefault(w, len(known)) for ws in other_words for w in ws], np.int64) + base
    mark_at = np.array([known.setdefault(m, len(known)) for m in marks], np.int64) + base
    more, more_lengths = raw_words(list(known))
    ids, sizes = vocab.merge(np.concatenate([text, more]), np.concatenate([np.diff(offsets), more_lengths]))
    starts = np.cumsum(sizes) - sizes
    # Words of each chunk.
    per_other = np.fromiter(map(len, other_words), np.int64, len(other_words))
    n_words = np.zeros(len(pieces) + len(first), np.int64)
    n_words[: len(pieces)][letters] = 1
    n_words[: len(pieces)][marked] = 2
    n_words[np.concatenate([rest, np.arange(len(pieces), len(n_words))])] = per_other
    begin = np.cumsum(n_words) - n_words
    word = np.empty(int(n_words.sum()), np.int64)
    n_letters = int(letters.sum())
    word[begin[: len(pieces)][letters]] = plain_word[:n_letters]
    word[begin[: len(pieces)][marked]] = plain_word[n_letters:]
    word[begin[: len(pieces)][marked] + 1] = mark_at
    slot = np.concatenate([rest, np.arange(len(pieces), len(n_words))]).astype(np.int64)
    word[ranges(begin[slot], per_other)] = other_at
    # Ids of each chunk, then of each text.
    word_ids = ids[ranges(starts[word], sizes[word])]
    upto = np.concatenate([[0], np.cumsum(sizes[word])])
    chunk_start, chunk_size = upto[begin], upto[begin + n_words] - upto[begin]
    opens, shuts = np.zeros(len(n_words), bool), np.zeros(len(n_words), bool)
    opens[rest] = [not c[1:2].strip() for c in others[: len(rest)]]
    shuts[slot] = [c[-1:].isspace() for c in others]
    joined = np.zeros(len(code) + 1, bool)
    joined[1:-1] = shuts[code[:-1]] & opens[code[1:]]
    inner = np.concatenate([[0], np.cumsum(joined)])
    flat = word_ids[ranges(chunk_start[code], chunk_size[code])].astype(np.uint32)
    ends = np.concatenate([[0], np.cumsum(chunk_size[code])])[edges]
    whole |= inner[np.maximum(edges[1:], edges[:-1] + 1)] > inner[np.minimum(edges[:-1] + 1, edges[1:])]
    return [encode_whole(vocab, column[i].as_py()) if whole[i] else flat[ends[i] : ends[i + 1]] for i in range(len(column))]


def groups(batches: Iterator[pa.RecordBatch], column: str, path: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of batches with the ids of their texts."""
    vocab = vocabulary(path)
    for part in slices(batches, column, ENCODED_CHARS):
        yield part, encode_group(vocab, part.column(column))


def encode(df: DataFrame, path: str, column: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """All columns but the text, and its ids as little-endian unsigned 32-bit integers in a binary column.

    With ``decoded``, a column of that name holds the text that the ids decode to, made in the same pass. Columns already
    called ``into`` or ``decoded`` are replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in (column, into, decoded)]
    names = [f.name for f in kept]
    added = [T.StructField(into, T.BinaryType())] + ([T.StructField(decoded, T.StringType())] if decoded else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part, ids in groups(batches, column, path):
            made = [binary_column([i.astype("<u4") for i in ids])] + ([pa.array([vocab.decode(i) for i in ids], pa.string())] if decoded else [])
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], [*names, *(f.name for f in added)])

    source = df.select(*[c for c in df.columns if c in names or c == column])
    return source.mapInArrow(run, T.StructType([*kept, *added]))


def decode(df: DataFrame, path: str, column: str = "ids", into: str = "text") -> DataFrame:
    """All columns, and the text of the ids in a column ``into``. Null ids give the empty text."""
    kept = [f for f in df.schema.fields if f.name != into]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for part in slices(batches, column):
            out = [vocab.decode(np.frombuffer(b or b"", "<u4")) for b in part.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(out, pa.string())], [*names, into])

    return df.drop(into).mapInArrow(run, T.StructType([*kept, T.StructField(into, T.StringType())]))
