"""Cases in which the operators once did less than the whole job."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from meterloom.llm import batches, licenses, minhash, pii, suffixtree, winnow

NOTICES = {
    "permission": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files",
    "gpl-notice": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.",
    "mpl-2.0": "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */",
    "warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY',
}


def test_wrapped_notices(spark):
    rows = [*NOTICES.items(), ("none", "Permission is hereby\n\n" + "other words stand here\n" * 9 + "granted, free of charge, to any person obtaining a copy")]
    rows += [(f"{label}-words", "\n".join(text.split())) for label, text in NOTICES.items()]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(docs).collect()}
    for label in NOTICES:
        assert label in got[label] and label in got[f"{label}-words"]
    assert got["none"] == [""]


@pytest.mark.parametrize(
    "found",
    [
        "ann ［at］ mail ［dot］ org",
        "ann at mail dоt org",
        "ann [at] mail dot org",
        "ann at mail [dot] org",
        "ann@mail dot org",
        "ann at mail.org",
        "a at mail dot org",
        "ann at mail dot shop",
        "call +4 ｏne two three four five six seven eight"[5:],
    ],
)
def test_stacked_and_mixed_disguises(found):
    text = f"write {found}, today"
    assert [text[a:b] for _, a, b in pii.spans(text)[1]] == [found]


@pytest.mark.parametrize("text", ["look at the dot product", "we met at noon. Then we left", "open at 10.30 on the dot today"])
def test_prose_is_no_address(text):
    assert pii.spans(text)[1] == []


def test_short_texts_share_marks_with_their_edits():
    sentence = "a quick fox ran over some lazy dogs while ten judges boxed with five wizards near my quay"
    for n in range(22, len(sentence)):
        text = sentence[:n]
        changed = winnow.edit(text, "0123456789" * 10)
        assert winnow.likeness(winnow.marks(text)[0], winnow.marks(changed)[0]) > 0


def test_suffix_tree_beyond_what_tasks_hold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    whole, parts = suffixtree.train(docs), suffixtree.train(docs, transitions=2000)
    assert whole[1].rest is None and parts[1].rest.count() > 2000 and sum(map(len, parts[1].keys)) <= 2000
    want = {r.doc_id: r for r in suffixtree.score(docs, whole).collect()}
    got = suffixtree.score(docs, parts).collect()
    assert len(got) == len(want)
    for r in got:
        assert abs(r.score - want[r.doc_id].score) < 1e-6 and abs(r.base_score - want[r.doc_id].base_score) < 1e-6
        assert (r.n_known, r.n_tokens) == (want[r.doc_id].n_known, want[r.doc_id].n_tokens)


def test_pipeline_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(None, ""), (None, a), (7, a), (7, a), (9, a + " more"), (None, b), (None, b), (3, ""), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.distinct(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(0, ""), (7, a), (0, b), (3, "")])


def test_near_copies_cost_as_many_pairs_as_there_are_copies(spark):
    """200 near copies in one node: the spanning pairs join them all, the full look would ship all 19,900."""
    words = [f"w{i}" for i in range(120)]
    texts = [(i, " ".join(words[:60] + [f"own{i}"] + words[60:])) for i in range(200)]
    sets = minhash.prepared(spark.createDataFrame(texts, "doc_id long, text string")).cache()
    live = sets.selectExpr("1L as node", "uid", "uid as own")
    spanning = minhash._compared(live, sets, True).cache()
    assert spanning.where("a is not null").count() == 199 and spanning.where("node = 1").count() == 1
    assert minhash._compared(live, sets, False).count() == 199 * 100
    got = minhash.clusters(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_pairs_kept_back_are_not_lost(spark):
    """Where a spanning pair looks likely and is no link, the pairs behind it are still compared: equal to all pairs."""
    draw = random.Random(2)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(120):  # likenesses around the threshold, on both sides
        words = list(base)
        for at in draw.sample(range(400), draw.randrange(1, 16)):
            words[at] = f"x{draw.randrange(30)}"
        texts.append((i, " ".join(words)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for _, t in texts for w in [t.split()]]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in minhash.clusters(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: root(i) for i in range(len(texts))} and len(set(got.values())) > 1


def test_pairs_that_stay_apart_are_decided_in_place(spark, monkeypatch):
    """Sets of which all look likely and few are links: only links that span a node leave it, also from blocks of few sets."""
    draw = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(90):
        words = list(base)
        for at in draw.sample(range(300), draw.randrange(3, 10)):
            words[at] = f"x{i}y{at}"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    sets = minhash.prepared(docs).cache()
    hashes = [minhash.shingles(t) for _, t in texts]
    uids = [r.uid for r in sets.orderBy("doc_id").collect()]

    def joined(links):
        parent = {u: u for u in uids}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        return {u: root(u) for u in uids}

    every = {frozenset((uids[i], uids[j])) for i in range(90) for j in range(i) for both in [len(set(hashes[i]) & set(hashes[j]))] if 100 * both >= 75 * (len(hashes[i]) + len(hashes[j]) - both)}
    want = joined(every)
    assert len(set(want.values())) > 1 and len(every) > 90
    live = sets.selectExpr("1L as node", "uid", "uid as own")
    found = sets.select("uid", "doc_id").join(docs, "doc_id").select("uid", "text")
    rows = minhash._undecided(live, sets)
    assert rows.count() <= 90 < minhash._compared(live, sets, False).count()
    for shingles in (minhash.BLOCK_SHINGLES, 4000):
        monkeypatch.setattr(minhash, "BLOCK_SHINGLES", shingles)
        got = [(r.a, r.b) for r in minhash._decided(rows, found).collect()]
        assert {frozenset(link) for link in got} <= every and joined(got) == want
        blocks = -(-rows.agg({"n": "sum"}).first()[0] // shingles)
        assert len(got) < 90 * blocks


def test_texts_are_found_behind_the_filter(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id) as text").unionByName(spark.createDataFrame([(None, "text none")], "doc_id long, text string"))
    wanted = docs.where("doc_id is null or doc_id % 50 = 0").selectExpr("coalesce(doc_id, -1) as uid", "doc_id", "xxhash64(text) as text_hash")
    source = docs.selectExpr("xxhash64(text) as text_hash", "text")
    assert 61 <= minhash._filtered(source, wanted, "text_hash").count() < 200
    monkeypatch.setattr(minhash, "BROADCAST_ROWS", 10)
    got = {r.uid: r.text for r in minhash._texts(wanted, docs).collect()}
    assert got == {i: f"text {i}" for i in range(0, 3000, 50)} | {-1: "text none"}


def test_states_are_gathered_by_length_as_arrow(spark):
    docs = spark.createDataFrame([(i, f"some words here {i % 7} and there {i % 3}") for i in range(200)], "doc_id long, text string")
    parts = list(suffixtree.gathered(suffixtree.parted(suffixtree.retained(suffixtree.levels(suffixtree.counted(docs)), 5000), 10**6)[0]))
    assert len(parts) == suffixtree.DEPTH + 1 and len(parts[0][0]) and all(len({len(c) for c in level}) == 1 for level in parts)
    assert all((level[0] < 1 << 8 * (k + 1)).all() for k, level in enumerate(parts))
    tree = suffixtree.Tree(parts)
    assert [len(k) for k in tree.keys] == [len(level[0]) for level in parts[1:]]


def test_rows_reach_python_in_small_batches(spark, monkeypatch):
    """10,000 long rows in one batch stay in the memory of an executor; batches are cut by bytes, and the setting comes back."""
    docs = spark.range(0, 20_000, 1, 1).selectExpr("id as doc_id", "concat(id, repeat('x', 1000)) as text")
    seen = []

    def run(parts):
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows])], ["rows"])

    def prepared(given):
        seen.extend(r.rows for r in given.select("text").mapInArrow(run, "rows long").collect())
        return whole(given)

    whole = minhash.prepared
    monkeypatch.setattr(minhash, "prepared", prepared)
    before = spark.conf.get(batches.BATCH_CONF)
    assert minhash.clusters(docs).where("n_shingles = 1 and kept").count() == 20_000
    assert sum(seen) == 20_000 and max(seen) * 1000 <= batches.BATCH_BYTES
    assert spark.conf.get(batches.BATCH_CONF) == before


def test_stages_of_the_pipeline_take_small_batches(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string")
    before = spark.conf.get(batches.BATCH_CONF)
    try:
        for _, stage in corpus_pipeline.STAGES[2:4]:
            spark.conf.set(batches.BATCH_CONF, before)
            assert stage(spark, docs, "").count() == 1 and int(spark.conf.get(batches.BATCH_CONF)) == batches.BATCH_BYTES
    finally:
        spark.conf.set(batches.BATCH_CONF, before)


def test_index_of_a_block_is_small():
    """A task holds two blocks; their index takes a few times the room of the shingles, and gives the links of all pairs."""
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 63, 400, np.int64).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: draw.integers(280, 400)], draw.integers(0, 1 << 63, 30, np.int64).astype(np.uint64)])) for _ in range(60)]
    a, b = minhash.spanning_links(np.arange(60), np.arange(60) % 2, sets)
    root = list(range(60))
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if (i + j) % 2 and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root = [root[j] if r == root[i] else r for r in root]
    got = list(range(60))
    for i, j in zip(a.tolist(), b.tolist(), strict=True):
        got = [got[j] if r == got[i] else r for r in got]
    same = lambda of: {frozenset(k for k in range(60) if of[k] == r) for r in of}
    assert same(got) == same(root) and len(same(root)) < 60
    many = [np.unique(draw.integers(0, 1 << 63, 1000, np.int64).astype(np.uint64)) for _ in range(500)]
    tracemalloc.start()
    minhash.spanning_links(np.arange(500), np.zeros(500, np.int64), many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * sum(s.nbytes for s in many)
