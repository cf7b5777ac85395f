"""Periodic runs, the prefix trie and toxicity: against plain versions, and on odd tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netvigil.llm import runs, toxicity, trie
from netvigil.llm.queries import QUERIES

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


def read(sf, name, *columns):
    return duckdb.sql(f"SELECT {', '.join(columns)} FROM '{sf}/{name}.parquet'").fetchall()


def sha(data):
    return hashlib.sha256(data).hexdigest()


# 11


def plain_runs(ids):
    """Every stretch that keeps each distance, least distance first."""
    n, found = len(ids), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            a = i
            while i + q < n and ids[i] == ids[i + q]:
                i += 1
            length = i - a + q
            if i > a and length >= max(12, 2 * q):
                found.setdefault((a, length), q)
            i += 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_squared_differences():
    rng = np.random.default_rng(2)
    for size in (2, 4, 64):
        top = int(((runs.MODULUS - 1) // size) ** 0.5)
        blocks = rng.integers(0, top, (5, size)).astype(np.uint64)
        windows = rng.integers(0, top, (5, 4 * size)).astype(np.uint64)
        windows[0, 3 : 3 + size] = blocks[0]
        got = runs.squared_differences(blocks, windows)
        b, w = blocks.astype(object), windows.astype(object)
        for r in range(5):
            for j in range(3 * size + 1):
                assert got[r, j] == sum((w[r, j : j + size] - b[r]) ** 2)
        assert got[0, 3] == 0


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_runs_of_random_words(data):
    ids = data.draw(st.lists(st.integers(0, data.draw(st.integers(0, 4))), max_size=90))
    for _ in range(data.draw(st.integers(0, 2))):
        if len(ids) > 3:
            p = data.draw(st.integers(1, len(ids) // 2))
            a = data.draw(st.integers(0, len(ids) - 1))
            for i in range(a + p, data.draw(st.integers(a, len(ids)))):
                ids[i] = ids[i - p]
    got = [tuple(map(int, r)) for r in runs.find_runs(np.array(ids, np.int64))]
    assert got == plain_runs(ids)


def test_long_runs():
    assert runs.find_runs(np.zeros(50_000, np.int64)).tolist() == [[0, 50_000, 1]]
    ids = np.concatenate([np.arange(900) % 41, 100 + np.arange(30_000) % 7_000, [5, 6]])
    assert runs.find_runs(ids).tolist() == [[0, 900, 41], [900, 30_000, 7_000]]
    with pytest.raises(ValueError):
        runs.find_runs(ids, 5)


def plain_op11(docs):
    out = []
    for doc, text in docs:
        ws = WORD.findall((text or "").encode())
        n, h = len(ws), None if doc is None else zlib.crc32(str(doc).encode())
        if h is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
        found = plain_runs(ws)
        gone = {i for a, m, q in found for i in range(a + q, a + m)}
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        lines = "".join(f"{a},{m},{q}\n" for a, m, q in found)
        out.append(
            (doc, len(found), *best, 1000 * best[1] // best[2] if found else None,
             sha(lines.encode()), sha(b" ".join(w for i, w in enumerate(ws) if i not in gone)))
        )
    return sorted(out, key=str)


def test_periodic_runs_query(spark, sf_dir):
    docs = [r for r in read(sf_dir, "documents", "doc_id", "text") if len((r[1] or "").split()) < 900]
    ids = {d for d, _ in docs}
    got = [r for r in rows(QUERIES["op11_periodic_runs"](spark, sf_dir)) if r[0] in ids]
    assert got == plain_op11(docs)
    assert sum(r[1] > 0 for r in got) > 50


def test_periodic_runs_of_odd_tables(odd, odd_docs, none):
    got = runs.periodic_runs(odd)
    assert "row" in got.columns and "text" not in got.columns
    expected = []
    for doc, text, *_ in odd_docs:
        ws = WORD.findall((text or "").encode())
        found = plain_runs(ws)
        gone = {i for a, m, q in found for i in range(a + q, a + m)}
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone).decode()
        expected.append((doc, len(ws), [tuple(r) for r in found], kept))
    seen = [
        (r[0], r[1], [tuple(x) for x in r[2]], r[3])
        for r in got.select("doc_id", "n_words", "runs", "collapsed").collect()
    ]
    assert sorted(seen, key=str) == sorted(expected, key=str)
    assert any(r[2] for r in seen)
    assert runs.periodic_runs(none).count() == 0


# 12


def plain_trie(conversations):
    """conversations: id -> tuple of (role, text)"""
    members, children = defaultdict(list), defaultdict(set)
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
            if d:
                children[turns[: d - 1]].add(turns[:d])

    def order(c):
        return (c is None, c or 0)

    leaves, saved, out = {}, {}, []
    for node in sorted(members, key=len, reverse=True):
        below = children[node]
        leaves[node] = sum(leaves[c] for c in below) if below else 1
        words = len(WORD.findall(node[-1][1].encode())) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[c] for c in below)
    for node, convs in members.items():
        ends = sorted((c for c in convs if len(conversations[c]) == len(node)), key=order)
        text = ",".join("" if c is None else str(c) for c in ends)
        out.append(
            (min(convs, key=order), len(node), min(members[node[:-1]], key=order) if node else None,
             len(convs), len(children[node]), leaves[node], saved[node], sha(text.encode()))
        )
    return sorted(out, key=str)


def rebuilt(turns):
    by = defaultdict(list)
    for conv, turn, role, text in turns:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: tuple((r, x) for _, _, r, x in sorted(ts)) for c, ts in by.items()}
    out = {}
    for conv, ts in own.items():
        h = 0 if conv is None else zlib.crc32(str(conv).encode()) % 4
        out[conv] = (own.get(conv - conv % 20, ())[:h] if h else ()) + ts[h:]
    return out


def test_prefix_trie_query(spark, sf_dir):
    turns = read(sf_dir, "conversations", "conv_id", "turn", "role", "text")
    assert rows(QUERIES["op12_prefix_trie"](spark, sf_dir)) == plain_trie(rebuilt(turns))


def odd_turns(seed):
    rng, out = random.Random(seed), []
    for conv in [*range(200), None]:
        null_turn = rng.randrange(12)
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            role = rng.choice(["user", "assistant", None])
            out.append((conv, None if t == null_turn else t, role, rng.choice(["a", "b c", "", None, "x  y"])))
    for conv in range(1000, 1300):  # a hot first turn, many equal conversations, some longer
        out += [(conv, 0, "user", "hot"), (conv, 1, "assistant", "b")]
        out += [(conv, 2, "user", str(conv % 7))] if conv % 3 == 0 else []
    out += [(2000, i, "user", "long") for i in range(60)] + [(7, 3, "user", "same")] * 2
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 5}, {"BLOCK_TURNS": 9, "PIECE": 30}])
@pytest.mark.parametrize("parts", [1, 7, 40])
def test_prefix_trie_over_partitions_and_blocks(spark, monkeypatch, limits, parts):
    for name, value in limits.items():
        monkeypatch.setattr(trie, name, value)
    turns = odd_turns(parts)
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    table = table.withColumns({c: F.lit("clash") for c in ("path", "key", "part", "at", "words")})
    settings_ = {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for key, value in settings_.items():
        spark.conf.set(key, value)
    try:
        found = trie.prefix_trie(trie.with_shared_heads(trie.turn_lists(table.repartition(4))))
        assert rows(found) == plain_trie(rebuilt(turns))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_prefix_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(trie.turn_lists(empty)).count() == 0
    alone = spark.createDataFrame([(None, None, None, None)], empty.schema)
    assert rows(trie.prefix_trie(trie.turn_lists(alone))) == plain_trie({None: (("", ""),)})


def test_extents_against_a_scan():
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 5, 77)
    row, depth = rng.integers(0, 77, 400), rng.integers(0, 6, 400)
    left, right = trie.extents(trie.sparse_table(shared), row, depth)
    for r, d, a, b in zip(row, depth, left, right, strict=True):
        x = y = r
        while x > 0 and shared[x] >= d:
            x -= 1
        while y + 1 < 77 and shared[y + 1] >= d:
            y += 1
        assert (a, b) == (x, y)


# 13

MILD = "the sun shines on green hills . a river runs past old stone walls . birds sing at dawn"


def labelled(spark, n=240):
    """A third is toxic by one sentence; a common harmless word stands in every document."""
    rng, docs, labels = random.Random(4), [], []
    for i in range(n):
        parts = [" ".join(rng.sample(MILD.split(), 8)) for _ in range(rng.randint(2, 6))]
        if i % 3 == 0:
            parts.insert(rng.randrange(len(parts)), rng.choice(["you vile grumph", "such a Snorkish lot"]))
        docs.append((i, ". ".join(parts)))
        labels.append((i, int(i % 3 == 0)))
    return (
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def test_gradient_by_differences():
    texts = ["bad word here. good words there!\nfine", "good words. fine", "", None, "bad. " * 3]
    block = toxicity.Encoded.of(texts, [1, 0, 0, 1, 1])
    again = toxicity.Encoded.unpack(block.pack())
    rng = np.random.default_rng(1)
    model = rng.normal(0, 0.3, toxicity.FEATURES + 1)
    model[-1] = -1.0
    slope = again.gradient(model)
    used = np.unique(block.feature)
    for at in [*used[:: max(1, len(used) // 15)], toxicity.FEATURES]:
        step = np.zeros_like(model)
        step[at] = 1e-5
        rise = block.gradient(model + step)[-1] - block.gradient(model - step)[-1]
        assert rise / 2e-5 == pytest.approx(slope[at], rel=1e-4, abs=1e-7)


def test_noisy_or_and_sentences():
    text = "One two! three\nfour five. " + "six " * 130
    found = toxicity.sentences(text)
    assert found[:3] == ["one two", "three", "four five"]
    assert [len(s.split()) for s in found[3:]] == [60, 60, 10]
    assert toxicity.sentences(None) == toxicity.sentences(" . ") == [""]
    z = np.array([0.3, -2.0, 1.5])
    p = 1 / (1 + np.exp(-z))
    whole, _ = toxicity.noisy_or(z, np.array([2, 1]))
    assert whole == pytest.approx([1 - (1 - p[0]) * (1 - p[1]), p[2]])


def test_offending_sentences_are_found(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs.where("doc_id % 4 <> 1"), labels)
    scored = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in scored if i % 4 == 1]
    assert all((scored[i]["score"] >= 0.5) == (i % 3 == 0) for i in held)
    found = toxicity.offending(docs, model).collect()
    assert {r["doc_id"] for r in found} == {i for i in scored if i % 3 == 0}
    assert all("grumph" in r["sentence"] or "snorkish" in r["sentence"] for r in found)
    worst = {r["doc_id"]: r["at"] for r in found}
    assert all(scored[i]["worst"] == at for i, at in worst.items())


def test_toxicity_query(spark, sf_dir):
    got = {r["doc_id"]: r for r in QUERIES["op13_toxicity"](spark, sf_dir).collect()}
    docs = read(sf_dir, "documents", "doc_id")
    assert len(got) == len(docs)
    marks = dict(read(sf_dir, "labels", "doc_id", "toxic"))
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["predicted"], marks[d]) for d, r in got.items() if r["held_out"] and d in marks]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)


def test_toxicity_of_odd_tables(spark, odd, none):
    labels = spark.createDataFrame(
        [(0, 1), (3, 0), (6, None), (None, 1), (24, 1), (24, 0), (36, 0)], "doc_id long, toxic int"
    )
    model = toxicity.train(odd, labels, rounds=5)
    scored = toxicity.score(odd, model)
    assert scored.count() == odd.count() and "row" in scored.columns
    assert all(0 <= r["score"] <= 1 for r in scored.select("score").collect())
    assert toxicity.score(none, model).count() == 0
    assert toxicity.offending(none, model).count() == 0
    # No label at all, and labels of one kind: one score for all texts.
    for kind, expected in ((labels.limit(0), None), (labels.where("doc_id = 3"), 0.25)):
        constant = toxicity.train(odd, kind)
        share = {round(r["score"], 6) for r in toxicity.score(
            odd.where("text IS NULL OR text IN ('', 'one')"), constant).collect()}
        assert len(share) == 1
        assert expected is None or share == {expected}


def test_training_takes_a_bounded_share(spark):
    docs, labels = labelled(spark)
    taken = toxicity.training_rows(docs, labels, 60)
    assert 20 < taken.count() < 110
    assert rows(taken) == rows(toxicity.training_rows(docs, labels, 60))
