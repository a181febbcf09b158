"""Hard negatives, source audit and chat formatting against brute force, and on nulls, ties, repeats, empty tables and skew."""

import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterloom.llm import audit, catalog, chat, negatives, oracles

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings conversations".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(oracles.SQL[name]).df()
    got = catalog.queries()[name](spark, SF).toPandas()
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).values))
    assert len(want) and sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


# Hard negatives


def mined(rows, is_anchor, k=5):
    """Every anchor against every row, one by one."""
    whole = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a, v, y in whole:
        if not is_anchor(a):
            continue
        others = sorted((-dot(v, w), i, z) for i, w, z in whole if i != a)
        for score, positive, _ in [o for o in others if o[2] == y][:k]:
            p = -score
            hard = [(i, -s) for s, i, z in others if z != y and 80 * p <= -100 * s <= 100 * p][:k]
            out += [(a, positive, rank, i, p, s) for rank, (i, s) in enumerate(hard, 1)]
    return sorted(out)


def vectors(n, seed, dims=8):
    draw = np.random.default_rng(seed)
    hot = [float(x) for x in draw.normal(size=dims).astype(np.float32)]
    rows = []
    for i in range(n):
        # A third of all rows has the same vector; few labels and coarse numbers make ties.
        v = hot if i % 3 == 0 else [float(x) for x in np.round(draw.normal(size=dims), 1).astype(np.float32)]
        rows.append((i, v, int(draw.integers(0, 3))))
    return rows


@pytest.mark.parametrize("bounds", [{}, {"codewords": 5, "shard_rows": 20, "anchor_rows": 7, "seed_rows": 15, "sample_rows": 50}])
def test_negatives_equal_brute_force(spark, bounds):
    rows = vectors(300, 1) + [(901, None, 1), (902, [1.0] * 8, None), (903, [float("nan")] + [0.0] * 7, 1), (904, [None] + [0.0] * 7, 1), (905, [float("inf")] * 8, 2), (None, [1.0] * 8, 1), (910, [0.5] * 3, 0), (920, [], 1)]
    # The fields clash with columns that the operator makes for itself.
    table = spark.createDataFrame([(*r, 0, 0, 0) for r in rows], "vec_id long, embedding array<float>, label int, cell int, rank int, uid long")
    got = sorted(tuple(r) for r in negatives.mine(table, F.col("vec_id") % 10 == 0, **bounds).collect())
    want = mined(rows, lambda i: i % 10 == 0)
    assert want and got == want


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**21 + 37 * i), float(2**20 - 11 * i), 1.0], i % 2) for i in range(40)]
    got = sorted(tuple(r) for r in negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), F.col("vec_id") % 10 == 0).collect())
    assert got == mined(rows, lambda i: i % 10 == 0)


def test_negatives_of_nothing(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(table, F.col("vec_id") % 10 == 0).collect() == []
    one = spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(one, F.col("vec_id") % 10 == 0).collect() == []
    assert negatives.mine(one, F.col("vec_id") == 1).collect() == []


def test_repeated_rows_are_rows(spark):
    rows = [(10, [1.0, 0.0], 0), (10, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.9, 0.0], 1), (2, [0.9, 0.0], 1)]
    got = Counter(tuple(r) for r in negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), F.col("vec_id") == 10).collect())
    want = Counter(mined(rows, lambda i: i == 10))
    assert got == want and len(got) and max(got.values()) > 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=1, max_size=6), st.lists(st.floats(-100, 100), min_size=1, max_size=6))
def test_pairs_come_by_falling_sum(a, b):
    pairs = list(negatives.by_bound(np.array(a), np.array(b)))
    assert sorted((i, j) for _, i, j in pairs) == [(i, j) for i in range(len(a)) for j in range(len(b))]
    assert all(x[0] >= y[0] for x, y in zip(pairs, pairs[1:], strict=False))


def test_a_window_is_certified_before_all_cells(spark):
    """Two far groups of vectors: the walk of an anchor does not reach the cells of the other group."""
    rows = [(i, [10.0 + i / 100, 0.0, 10.0, 0.0] if i % 2 else [-10.0 - i / 100, 0.0, -10.0, 0.0], 0) for i in range(200)]
    index = negatives.build(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), codewords=4)
    walk = negatives.Walk(index.books, index.counts, index.radii, 1000)
    anchor = negatives.matrix(spark.createDataFrame([(rows[1][1],)], "v array<double>").toArrow().column(0).combine_chunks(), 4)[0]
    cells = walk.cells(anchor, [0], [negatives.MOST], seeding=False)
    assert 0 < index.counts[cells].sum() <= 100 == index.counts.sum() / 2


# Source audit


def audited(rows, documents, top):
    word = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, within, total = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = word.findall((text or "").translate(lower))
        counts[lang or "", source or ""].update(terms)
        total[lang or ""].update(terms)
        within[lang or ""].update(set(terms))
    out = []
    for (lang, source), own in counts.items():
        kept = [t for t, n in within[lang].items() if n >= documents]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}  # noqa: E731, B023
        price = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = share(own), share(total[lang])
        pairs = [(other, sum(price(p[t], r[t]) for t in kept)) for (la, other), c in counts.items() if la == lang and other != source for r in [share(c)]]
        terms = [(t, price(p[t], q[t])) for t in kept if own[t] > 0 and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            order = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, rank) for rank, (item, value) in enumerate(order, 1)]
    return sorted(out)


def corpus(seed):
    draw = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{'é' * (i % 3)}{chr(97 + i // 26)}" for i in range(120)]
    rows = []
    for i in range(150):
        lang = ["de", "en", None, "fr"][i % 4]
        source = None if i % 17 == 0 else f"s{min(i % 9, 4 + i % 5)}"
        # One word makes up a third of all; later words are rare.
        text = " ".join("The" if draw.random() < 0.33 else words[int(len(words) * draw.random() ** 3)] for _ in range(draw.randrange(40)))
        rows.append((text.replace(" ", "-1 ", 2).upper() if i % 5 == 0 else text, lang, source))
    return rows + [(None, "en", "empty"), ("", "it", "x"), ("", "it", "y"), (None, None, None), rows[3], rows[3]]


@pytest.mark.parametrize("bounds", [{}, {"term_rows": 7, "group_rows": 2, "columns": 12}, {"group_rows": 3, "columns": 1}])
def test_audit_equals_brute_force(spark, bounds):
    rows = corpus(3)
    table = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], "text string, lang string, source string, n int, term string, value long, rank int")
    got = sorted(tuple(r) for r in audit.audit(table, documents=4, top=3, **bounds).collect())
    want = audited(rows, 4, 3)
    assert got == want
    assert {r[2] for r in want} == {"pair", "term"} and any(r[4] == 0 for r in want) and any(r[4] > 0 for r in want)


def test_audit_of_nothing(spark):
    assert audit.audit(spark.createDataFrame([], "text string, lang string, source string")).collect() == []
    got = audit.audit(spark.createDataFrame([("Only one", "en", "a")], "text string, lang string, source string")).collect()
    assert got == []


def test_very_long_text_is_read_in_pieces(monkeypatch):
    text = b"abc de " * 1000 + b"x" * 500 + b" end"
    monkeypatch.setattr(audit, "PIECE", 50)
    assert [w for words in audit._pieces(text) for w in words] == text.split()


def test_counts_beyond_64_bits(spark):
    """A count of 10 ** 13 times a thousand millions has 23 digits."""
    n, total, kept = 10**13, 3 * 10**13, 10**7
    row = spark.range(1).select(audit.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 2) // (total + 2 * kept)


# Chat formatting


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*"<>|[]/\\sS😀", *chat.CONTROL, "INST]", "<|", "SYS>>"]), max_size=12).map("".join))
def test_escapes_are_reversible(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


def test_unfit_control_strings_are_refused():
    for control in (("x",), ("a\\b",), ("<a>", "<<a>"), ("<a>", "a><")):
        with pytest.raises(ValueError):
            chat.pattern(control)


def folded(log):
    """One event after the other, over all messages of all conversations."""
    messages = {}
    seen = set()
    none = lambda x: (x is not None, x if x is not None else 0)
    words = lambda x: (x is not None, x or "")
    for conv, message, place, seq, kind, role, text in sorted(log, key=lambda e: (none(e[3]), words(e[4]), words(e[5]), words(e[6]))):
        if (conv, message, seq) in seen:
            continue
        seen.add((conv, message, seq))
        m = messages.setdefault((conv, message), [None, None, ""])
        if kind == "open" and m[0] is None:
            m[0] = place
        if m[1] is None:
            m[1] = role
        if kind == "edit":
            m[2] = text or ""
        elif kind == "regenerate":
            m[2] = ""
        elif kind in ("open", "delta"):
            m[2] += text or ""
    return Counter((conv, place, role or "", text) for (conv, _), (place, role, text) in messages.items())


def test_fold_equals_a_replay(spark):
    draw = random.Random(5)
    log = []
    for conv in (1, 2, None):
        for message in range(5 if conv != 2 else 60):
            name = None if message == 4 else f"m{message}"
            for seq in range(draw.randrange(0, 12)):
                kind = "open" if seq == 0 and draw.random() < 0.9 else draw.choice(["delta", "delta", "delta", "edit", "regenerate", "unheard", None])
                log.append((conv, name, message if kind == "open" else None, None if draw.random() < 0.05 else seq, kind, draw.choice(["user", "assistant", None]), draw.choice(["a ", "bé", None, "", "x" * 50])))
    log += draw.choices(log, k=60)  # delivered twice
    draw.shuffle(log)
    table = spark.createDataFrame([(*e, 9) for e in log], chat.EVENTS + ", formatted int")
    assert Counter(tuple(r) for r in chat.fold(table).collect()) == folded(log)


def test_streamed_edited_and_regenerated_rows_end_as_they_are(spark):
    """False starts and drafts before the last version leave no trace in the output."""
    rows = [(1, 0, "user", "why </s>?"), (1, 1, "assistant", "because [INST]\n<|end|>"), (2, 0, "assistant", "")]
    log = []
    for conv, turn, role, text in rows:
        m = f"{conv}-{turn}"
        log += [(conv, m, turn, 0, "open", role, "draft"), (conv, m, None, 1, "delta", None, " more"), (conv, m, None, 2, "regenerate", None, None), (conv, m, None, 3, "delta", None, "second"), (conv, m, None, 4, "edit", None, text[:4])]
        log += [(conv, m, None, 5 + i, "delta", None, c) for i, c in enumerate(text[4:])]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    direct = chat.digests(chat.render(chat.fold(chat.log_of(plain))))
    replayed = chat.digests(chat.render(chat.fold(spark.createDataFrame(log, chat.EVENTS))))
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, replayed.collect()))


def test_formatted_rows_and_masks(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s> ok"), (1, 2, "assistant", None), (1, 3, None, "x"), (1, 4, "to<|end|>ol", "y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = sorted(chat.render(chat.fold(chat.log_of(table, piece=2))).collect(), key=lambda r: r.place)
    assert [r.formatted for r in out] == ["<|start|>user<|message|>hi<|end|>", "<|start|>assistant<|message|><\\/s> ok<|end|>", "<|start|>assistant<|message|><|end|>", "<|start|><|message|>x<|end|>", "<|start|>to<\\|end|>ol<|message|>y<|end|>"]
    assert [chat.parse(r.formatted) for r in out] == [(r[2] or "", r[3] or "") for r in rows]
    assert [r.formatted[r.loss_start : r.loss_end] if r.loss_start is not None else None for r in out] == [None, "<\\/s> ok", "", None, None]


def test_digests_equal_plain_hashes(spark):
    draw = random.Random(8)
    rows = [(draw.choice([1, 1, 1, 2, 3, None]), draw.choice([0, 1, 2, 2, None, 10**12]), draw.choice(["user", "assistant", None]), draw.choice(["a", "[/INST]", None, "é" * 700, ""])) for _ in range(80)]
    rows += rows[:5]
    # A place of its own for each remaining tie keeps the expected order simple: equal places go by role, then text as formatted.
    table = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, seq int, kind string")
    want = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", f"<|message|>{chat.escape(r[3] or '')}<|end|>".encode())):
        want.setdefault(conv, []).append((role or "", text or ""))
    got = {r.conv_id: r for r in chat.digests(chat.render(chat.fold(chat.log_of(table)))).collect()}
    assert set(got) == set(want)
    for conv, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_empty_log(spark):
    assert chat.digests(chat.render(chat.fold(spark.createDataFrame([], chat.EVENTS)))).collect() == []
    assert chat.fold(chat.log_of(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []
