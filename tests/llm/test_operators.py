"""Each operator against brute force, and on nulls, empty and repeated rows, empty tables and clashing columns."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from meterloom.llm import bpe, catalog, dac, licenses, minhash, packing, pii, rules, suffixtree, toxicity, winnow

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, score string, kept string, spans string"
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog again", "en", "a", 1, "x", "x", "x", "x"),
    (2, None, None, None, None, None, None, None, None),
    (3, "", "en", "a", 0, "x", "x", "x", "x"),
    (None, "the quick brown fox jumps over the lazy dog again", "en", "a", 1, "x", "x", "x", "x"),
    (4, "the quick brown fox jumps over the lazy dog again", None, "a", 1, "x", "x", "x", "x"),
    (4, "the quick brown fox jumps over the lazy dog again", None, "a", 1, "x", "x", "x", "x"),
    (5, "z" * 3000 + " " + "word " * 2000, "en", "a", 1, "x", "x", "x", "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def table(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def u4(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\tab.'s!1é²٣  😀中")), max_size=30), min_size=1, max_size=5))
def test_bpe_equals_the_library(texts):
    library = Tokenizer.from_file(PATH)
    vocab = bpe.vocabulary(PATH)
    for text, ids in zip(texts, bpe.encode_group(vocab, pa.array(texts, pa.string())), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert vocab.decode(ids) == text


def test_bpe_long_words_and_special_tokens():
    library = Tokenizer.from_file(PATH)
    texts = ["a" * 5000, "ab" * 900 + " x", "one <|endoftext|> two", "<|endoftext|>", "   a", "\n  b"]
    got = bpe.encode_group(bpe.vocabulary(PATH), pa.array(texts))
    assert [g.tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_bpe_frames(docs, none):
    coded = bpe.decode(bpe.encode(docs, PATH), PATH)
    assert sorted(r.text for r in coded.collect()) == sorted(r[1] or "" for r in ROWS)
    assert sorted(r.text for r in bpe.encode(docs, PATH, decoded="text").collect()) == sorted(r[1] or "" for r in ROWS)
    assert bpe.encode(none, PATH).count() == 0


def test_token_files(spark, docs, none, table, tmp_path):
    library = Tokenizer.from_file(PATH)
    manifest, listed = dac.write(spark.createDataFrame(table, "doc_id long, text string"), str(tmp_path / "a"), PATH, file_ids=20_000)
    assert manifest.count() > 1
    got = {r.doc_id: r for r in dac.read(manifest, listed).collect()}
    at = 0
    for doc_id, text in table:
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        assert (got[doc_id].start, got[doc_id].n_tokens, bytes(got[doc_id].ids)) == (at, len(ids), u4(ids))
        at += len(ids)
    manifest, listed = dac.write(docs, str(tmp_path / "b"), PATH)
    assert sorted(r.start for r in dac.read(manifest, listed).collect())[0] == 0 and dac.read(manifest, listed).count() == len(ROWS)
    manifest, listed = dac.write(none, str(tmp_path / "c"), PATH)
    assert dac.read(manifest, listed).count() == 0


def test_random_access():
    rng = np.random.default_rng(3)
    ids = rng.choice([0, 5, 255, 256, 70_000, 2**24, 2**32 - 1], 5000).astype(np.uint32)
    writer = dac.Writer()
    for part in np.split(ids, [0, 17, 1030]):
        writer.add(part)
    reader = dac.Reader(writer.image())
    assert reader.tokens(0, 5000).tolist() == ids.tolist()
    assert all(reader.token(i) == ids[i] for i in range(0, 5000, 7))
    assert reader.document(2).tolist() == ids[17:1030].tolist()
    with pytest.raises(IndexError):
        reader.token(5000)


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) < 256 for p in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"ab@.-+0123456789 ()\n_%", "a@b.co", "10.2.3.4", "4111111111111111", "+1 (555) 123-4567"]), max_size=25))
def test_base_spans(parts):
    text = "".join(parts)
    assert pii.identifiers(text) == plain_spans(text)
    assert set(plain_spans(text)) <= set(pii.spans(text)[1])


@pytest.mark.parametrize(
    "text, found",
    [
        ("write to ann [at] mail [dot] org today", "ann [at] mail [dot] org"),
        ("ann at mail dot org", "ann at mail dot org"),
        ("аnn@mаil.org", "аnn@mаil.org"),
        ("call +4 one two three four five six seven eight", "+4 one two three four five six seven eight"),
        ("host 10[.]0[.]0[.]7", "10[.]0[.]0[.]7"),
        ("she met us at noon and lost one of two keys", None),
    ],
)
def test_disguises(text, found):
    assert [text[a:b] for _, a, b in pii.spans(text)[1]] == ([found] if found else [])


def test_pii_frames(docs, none):
    assert pii.detect(docs).count() == len(ROWS) and pii.detect(none).count() == 0
    assert sorted(r.text is None for r in pii.redact(docs).collect()) == [False] * 6 + [True]


def test_toxicity(spark, docs, none):
    text = lambda i: f"plain words number {i} go here" + (" you utter blockhead" if i % 3 == 0 else " utter nonsense")
    rows = spark.createDataFrame([(i, text(i)) for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(rows, labels)
    scored = {r.doc_id: r.score for r in toxicity.score(rows, model).collect()}
    assert all((scored[i] >= 0.5) == (i % 3 == 0) for i in range(300))
    disguised = spark.createDataFrame([(1, "you utter bl0ckhe4d"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.score >= 0.5 for r in toxicity.score(disguised, model).orderBy("doc_id").collect()] == [True, False, False]
    assert toxicity.score(docs, model).count() == len(ROWS)
    assert toxicity.fit(none, labels).weights == {}


def test_exceptions():
    model = toxicity.Model({"rat*": 5.0}, frozenset({"lab rat"}))
    automaton = model.automaton()
    assert toxicity.load(automaton, model.exceptions, "you rat")[0] == 5.0
    assert toxicity.load(automaton, model.exceptions, "a lab rat")[0] == 0.0
    assert toxicity.load(automaton, model.exceptions, "karate")[0] == 0.0


def test_quality(spark, docs, none, table):
    got = {r.doc_id: r for r in rules.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    for doc_id, text in table:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {j + k for j in range(len(words) - 2) if windows[tuple(words[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.kept and r.base_failed)
    assert rules.judge(docs).count() == len(ROWS) and rules.judge(none).count() == 0
    assert rules.distance(np.array([1.0, 0]), np.array([0.0, 1])) == 1.0


def test_packing(docs, none, spark):
    packed = packing.pack(spark.read.parquet(f"{SF}/documents.parquet"), PATH).collect()
    filled = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 1024 and sum(v < 1024 for v in filled.values()) <= 1
    whole = {}
    for r in sorted(packed, key=lambda r: (r.doc_id, r.start)):
        assert r.start == sum(map(len, whole.get(r.doc_id, []))) // 4
        whole.setdefault(r.doc_id, []).append(bytes(r.ids))
    library = Tokenizer.from_file(PATH)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(b"".join(p) == u4([*library.encode(text[i], add_special_tokens=False).ids, 0]) for i, p in whole.items())
    assert packing.pack(docs, PATH).count() >= len(ROWS) and packing.pack(none, PATH).count() == 0


def test_suffix_tree(spark, docs, none, table):
    frame = spark.createDataFrame(table, "doc_id long, text string")
    trained = suffixtree.train(frame)
    counts = Counter(w for _, t in table for w in [*t.encode().lower().split(), None])
    total, different = sum(counts.values()), len(counts)
    assert trained[2:] == (total, different)
    got = {r.doc_id: r for r in suffixtree.score(frame, trained, frequent=50).collect()}
    for doc_id, text in table:
        words = [*text.encode().lower().split(), None]
        base = sum(np.log10((counts[w] + 0.5) / (total + 0.5 * (different + 1))) for w in words)
        assert (got[doc_id].n_tokens, got[doc_id].n_known) == (len(words), len(words)) and abs(got[doc_id].base_score - base) < 1e-6
    # The distribution after any context sums to one.
    for context in (0x7468, 0x20, 0x0909090909):
        total_p = (10 ** trained[1].score((np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64))).sum()
        assert abs(total_p - 1) < 1e-9
    assert suffixtree.score(docs, trained).count() == len(ROWS)
    assert suffixtree.score(docs, suffixtree.train(none)).count() == len(ROWS)


def test_licenses(spark, docs, none):
    rows = [(1, "x\nLicensed under the Apache License, Version 2.0."), (2, "All rights  Reserved, cc-by all rights reserved"), (3, "the mit license"), (4, None)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].labels, got[1].n_base, got[1].score) == ("apache-2.0", 0, 1.0)
    assert (got[2].base_labels, got[2].n_base, got[2].first_word, got[2].last_word, got[2].n_words) == ("cc-by,reserved", 3, 0, 5, 8)
    assert (got[3].labels, got[4].n_words, got[4].first_word) == ("", 0, None)
    assert licenses.scan(docs).count() == len(ROWS) and licenses.scan(none).count() == 0


def test_winnowing(spark, docs, none, table):
    for _, text in [*table[:20], (0, "a"), (0, "x" * 500)]:
        hashes, places = winnow.marks(text, 5, 8)
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        every = [int(winnow.kgrams(points[j:], min(5, len(points)))[0] >> np.uint64(32)) for j in range(max(1, len(points) - 4))]
        w = min(8, len(every))
        want = sorted({max(z for z in range(j, j + w) if every[z] == min(every[j : j + w])) for j in range(len(every) - w + 1)})
        assert places.tolist() == want and hashes.tolist() == [every[j] for j in want]
    got = {r.doc_id: r for r in winnow.with_edits(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert len(got) == len(table)
    for k, (doc_id, text) in enumerate(table):
        assert got[doc_id].edited == winnow.edit(text, table[k - 1][1])
    assert winnow.with_edits(docs).count() == len(ROWS) and winnow.with_edits(none).count() == 0
    assert winnow.with_edits(docs.limit(1)).count() == 1 and winnow.fingerprints(none).count() == 0


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates(docs, none, spark, table):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(120)]
    near = [(1000 + i, " ".join(w if rng.random() > 0.012 else f"e{i}" for w in words)) for i in range(60)]
    rows = table + near
    got = {r.doc_id: r for r in minhash.clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    name = {i: i for i in sets}

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                name[b] = a
    assert {i: r.component_id for i, r in got.items()} == {i: root(i) for i in ids}
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == r.component_id) for i, r in got.items())
    edge = minhash.clusters(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in edge) == [(0, 1), (1, 1), (2, 2), (3, 3), (4, 1), (4, 1), (5, 5)]
    assert minhash.clusters(none).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = p.quality(spark, docs, SF)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    left = p.clean(spark, kept, SF)
    one = p.distinct(spark, left, SF)
    assert one.columns == docs.columns and one.count() <= left.count() <= kept.count()
    assert [r.component_id == r.doc_id for r in minhash.clusters(one).collect()] == [True] * one.count()
    masked = p.private(spark, one, SF)
    assert masked.columns == docs.columns and all(not pii.identifiers(r.text) for r in masked.collect())
    assert p.packed(spark, masked, SF).select("doc_id").distinct().count() == one.count()


def test_digests(spark):
    first = catalog.queries()["op2_bpe"](spark, SF).orderBy("doc_id").first()
    text = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").first().text
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert (first.ids_sha256, first.decoded_sha256) == (hashlib.sha256(u4(ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    stored = catalog.queries()["op3_token_files"](spark, SF).orderBy("doc_id").first()
    assert stored.ids_crc32 == zlib.crc32(u4([*ids, 0]))
