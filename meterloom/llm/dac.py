"""Token ids in files of directly addressable codes.

An id is cut into chunks of ``CHUNK_BITS`` bits, lowest first. Level 0 holds the first chunk of every id; a bitmap per
level says which ids go on to the next one, where their chunks lie in order. The place of an id in the next level is the
number of set bits before it: a directory holds that count at every ``BLOCK_BITS`` bits, and the rest is counted inside
one block. So any id is read from a few bytes of each level, without decoding what lies before it.

File: ``MAGIC``, number of documents and ids (u64 each), ``starts`` (u64 per document plus one), number of levels (u32),
then per level its length (u64), its chunks (u8 each), its bitmap (u8, lowest bit first) and its directory (u64 per
block plus one). All numbers are little-endian.

Documents are range-partitioned and sorted by id (nulls first; repeated ids by their text), so files in order of their
first document hold the corpus in ascending order. Files close at a document once they hold ``FILE_IDS`` ids. Every
attempt of a task writes names of its own, and only files named in the manifest, which Spark commits, count: a lost
executor leaves at most files nobody reads. Null and empty texts are one end id. An empty table gives no files.
"""

from __future__ import annotations

import io
import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .batches import stored

MAGIC = b"DACTOK01"
CHUNK_BITS = 8
BLOCK_BITS = 512
FILE_IDS = 4_000_000


class Writer:
    """Collects documents and yields the bytes of one file."""

    def __init__(self) -> None:
        self.docs: list[np.ndarray] = []
        self.tokens = 0

    def add(self, ids: np.ndarray) -> None:
        self.docs.append(ids)
        self.tokens += len(ids)

    def image(self) -> bytes:
        out = io.BytesIO()
        out.write(MAGIC + struct.pack("<QQ", len(self.docs), self.tokens))
        out.write(np.concatenate([[0], np.cumsum([len(d) for d in self.docs])]).astype("<u8").tobytes())
        rest = np.concatenate(self.docs).astype(np.uint64) if self.docs else np.empty(0, np.uint64)
        levels = []
        while True:
            more = rest >= 1 << CHUNK_BITS
            bits = np.packbits(more, bitorder="little")
            blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK_BITS), dtype=np.uint64) if len(more) else np.empty(0)
            levels.append((len(rest), (rest & np.uint64((1 << CHUNK_BITS) - 1)).astype(np.uint8), bits, np.concatenate([[0], np.cumsum(blocks)])))
            if not more.any():
                break
            rest = rest[more] >> np.uint64(CHUNK_BITS)
        out.write(struct.pack("<I", len(levels)))
        for n, chunks, bits, directory in levels:
            out.write(struct.pack("<Q", n) + chunks.tobytes() + bits.tobytes() + directory.astype("<u8").tobytes())
        return out.getvalue()


class Reader:
    """Random access to the ids of one file; ``data`` is its bytes or a memory map."""

    def __init__(self, data: bytes | memoryview):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self.n_docs, self.n_tokens = struct.unpack_from("<QQ", data, 8)
        at = 24
        self.starts = np.frombuffer(data, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        (n_levels,) = struct.unpack_from("<I", data, at)
        at += 4
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            at += 8
            n_bits, n_blocks = -(-n // 8), -(-n // BLOCK_BITS)
            chunks = np.frombuffer(data, np.uint8, n, at)
            bits = np.frombuffer(data, np.uint8, n_bits, at + n)
            directory = np.frombuffer(data, "<u8", n_blocks + 1, at + n + n_bits)
            at += n + n_bits + 8 * (n_blocks + 1)
            self.levels.append((chunks, bits, directory))

    def _rank(self, level: int, place: int) -> int:
        """Set bits of a level before a place: the directory, then the bytes of one block."""
        _, bits, directory = self.levels[level]
        block, inside = divmod(place, BLOCK_BITS)
        if not inside:
            return int(directory[block])
        lo = block * BLOCK_BITS // 8
        return int(directory[block]) + int(np.unpackbits(bits[lo : lo + -(-inside // 8)], count=inside, bitorder="little").sum())

    def token(self, place: int) -> int:
        """One id."""
        if not 0 <= place < self.n_tokens:
            raise IndexError(place)
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[place]) << level * CHUNK_BITS
            if not bits[place >> 3] >> (place & 7) & 1:
                break
            place = self._rank(level, place)
        return value

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo`` to ``hi``: their chunks lie side by side in every level."""
        n = hi - lo
        out = np.zeros(n, np.uint32)
        where = np.arange(n)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if lo == hi:
                break
            out[where] |= chunks[lo:hi].astype(np.uint32) << np.uint32(level * CHUNK_BITS)
            more = np.unpackbits(bits[lo >> 3 : (hi + 7) >> 3], bitorder="little")[lo & 7 :][: hi - lo].astype(bool)
            where = where[more]
            lo = self._rank(level, lo)
            hi = lo + len(where)
        return out

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.starts[i]), int(self.starts[i + 1]))


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder name, which has a scheme or is a local path."""
    if "://" in folder:
        return pafs.FileSystem.from_uri(folder)
    if folder.startswith("file:"):
        folder = folder[len("file:") :]
    return pafs.LocalFileSystem(), os.path.abspath(folder)


def write(docs: DataFrame, folder: str, path: str, end_id: int = 0, file_ids: int = FILE_IDS) -> tuple[DataFrame, DataFrame]:
    """Encode ``doc_id, text``, append ``end_id`` to each document and write the files below ``folder``.

    Returns the manifest (one row per file: path, number of documents and ids, place of its first id in the corpus as
    ``base``) and the catalog (one row per document: doc_id, path, index in the file). Other columns are left out.
    """
    files = f"{folder}/files"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        store, root = _place(files)
        store.create_dir(root, recursive=True)
        writer, ids, seq = Writer(), [], 0

        def close() -> pa.RecordBatch:
            nonlocal writer, ids, seq
            name = f"part-{part:06d}-{seq:06d}-{uuid.uuid4().hex}.dac"
            with store.open_output_stream(f"{root}/{name}") as f:
                f.write(writer.image())
            n = len(ids)
            sizes = [len(d) for d in writer.docs]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array([f"{files}/{name}"] * n, pa.string()), pa.array([part] * n, pa.int64()),
                    pa.array([seq] * n, pa.int64()), pa.array(np.arange(n)), pa.array(sizes, pa.int64()),
                ],
                ["doc_id", "path", "part", "seq", "index", "n_tokens"],
            )
            writer, ids, seq = Writer(), [], seq + 1
            return out

        for group, coded in bpe.groups(batches, "text", path):
            for doc_id, tokens in zip(group.column("doc_id").to_pylist(), coded, strict=True):
                writer.add(np.append(tokens, np.uint32(end_id)))
                ids.append(doc_id)
                if writer.tokens >= file_ids:
                    yield close()
        if ids:
            yield close()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("path", T.StringType()), T.StructField("part", T.LongType()),
        T.StructField("seq", T.LongType()), T.StructField("index", T.LongType()), T.StructField("n_tokens", T.LongType()),
    ])
    catalog = stored(ordered.mapInArrow(run, schema), "dac-catalog")
    sizes = catalog.groupBy("path", "part", "seq").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    # Places of parts, then of the files inside a part: no window sees all files.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    totals = {r.part: r.n for r in parts.collect()}  # one number per write task
    base, at = {}, 0
    for part in sorted(totals):
        base[part], at = at, at + totals[part]
    spark = docs.sparkSession
    bases = spark.createDataFrame(list(base.items()) or [(0, 0)], "part long, part_base long")
    earlier = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    manifest = sizes.join(bases, "part").select("path", "part", "seq", "n_docs", "n_tokens", (F.col("part_base") + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).alias("base"))
    return manifest, catalog.select("doc_id", "path", "index")


def read(manifest: DataFrame, catalog: DataFrame) -> DataFrame:
    """All documents read back from the files: doc_id, start (ids of all documents before it), n_tokens, ids (u32 binary).

    A task opens the files of its rows one after the other; documents of a file are read by their place in it.
    """
    wanted = catalog.join(manifest.select("path", "base"), "path").select("path", "index", "doc_id", "base").repartition("path").sortWithinPartitions("path", "index")
    return wanted.mapInArrow(_read_rows, "doc_id long, start long, n_tokens long, ids binary")


def _read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened, reader = None, None
    for batch in batches:
        out: list[tuple] = []
        held = 0
        for path, index, doc_id, base in zip(*(batch.column(c).to_pylist() for c in ("path", "index", "doc_id", "base")), strict=True):
            if path != opened:
                store, name = _place(path)
                with store.open_input_file(name) as f:
                    reader, opened = Reader(f.read()), path
            ids = reader.document(index)
            out.append((doc_id, base + int(reader.starts[index]), len(ids), ids.astype("<u4").tobytes()))
            held += len(ids)
            if held >= 1_000_000:
                yield _rows(out)
                out, held = [], 0
        if out:
            yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
