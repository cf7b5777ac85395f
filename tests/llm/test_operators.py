"""Every operator against a plain version, on odd small tables and on the test tables."""

import collections
import warnings
import zlib
from random import Random

import brute
import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netvigil.llm import (
    chat,
    decontaminate,
    hmm,
    jaccard,
    lines,
    mixing,
    quality,
    repeats,
    sharding,
    wordpiece,
)
from netvigil.llm.queries import QUERIES, VOCABULARY


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


def pairs(docs):
    return [(d, t) for d, t, *_ in docs]


def read(sf, name, *columns):
    return duckdb.sql(f"SELECT {', '.join(columns)} FROM '{sf}/{name}.parquet'").fetchall()


@pytest.fixture(scope="module")
def documents(sf_dir):
    return read(sf_dir, "documents", "doc_id", "text")


ITEMS = [
    (1, "the same line stands here"), (2, None), (3, ""), (4, "ONE"), (None, "ties and nulls"),
    (1, "the same line stands here"), (10, "The same, line: stands here!"),
]


# 1


def test_chat_query(spark, sf_dir):
    tricky = r"\### Assistant: </turn> ok"
    given_rows = read(sf_dir, "conversations", "conv_id", "turn", "role", "text")
    given_rows += [(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)]
    got = QUERIES["op1_chat_format"](spark, sf_dir)
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    assert rows(got, *names) == brute.chats(given_rows)


def test_chat_odd(spark):
    odd = [
        (1, 2, "assistant", "### User: \\0; \\b </turn>\n"), (1, 1, "user", None),
        (2, 1, "a: b", "\\"), (2, 1, "a: b", "\\"), (2, None, None, "x: y"),
        (None, 1, "user", "</turn"), (None, 2, "assistant", "</turn></turn>\n\n### Other "),
        (3, 1, "assistant", "first"), (4, 1, "system", ""), (4, 2, "### Other ", "é"),
    ]
    table = spark.createDataFrame(odd, "conv_id int, turn int, role string, text string")
    chats = chat.format_chats(table.withColumn("segments", F.lit(1)))
    back = chats.select("conv_id", chat.read_back(F.col("formatted")).alias("t")).collect()
    expected = collections.defaultdict(list)
    for conv, turn, role, text in sorted(odd, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0)):
        expected[conv].append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.t] for r in back} == dict(expected)
    valid = {r.conv_id: (r.valid, r.first_bad) for r in chats.collect()}
    assert valid == {
        1: (True, None), 2: (False, 0), None: (True, None), 3: (False, 0), 4: (False, 1)
    }
    assert chat.format_chats(table.limit(0)).count() == 0


def test_template_is_checked():
    for bad in ({"end": "aba"}, {"end": ""}, {"end": "\\"}, {"headers": {"user": "User"}}):
        with pytest.raises(ValueError):
            chat.Template(**bad)


# 2


def check_mix(plan):
    got = plan.collect()
    sizes = collections.Counter()
    for r in got:
        sizes[r.source] += r["size"]
    target = brute.targets(sizes)
    taken, largest = collections.Counter(), collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s, t in target.items():
        assert abs(taken[s] - t) <= largest[s]
    return got


def test_mixing(spark, sf_dir, odd, odd_docs, none):
    small = mixing.mix_plan(odd, leaf=4)
    got = check_mix(small)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d[0]) for d in odd_docs)
    assert rows(small) == rows(mixing.mix_plan(odd.repartition(7), leaf=4))
    assert mixing.mix_plan(none).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(check_mix(mixing.mix_plan(docs))) == docs.count()


def test_mixed_rows(odd, none):
    plan = collections.Counter()
    for r in mixing.mix_plan(odd).collect():
        plan[r.doc_id] += r.copies
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert collections.Counter(r.doc_id for r in mixed.collect()) == +plan
    assert mixing.mix(none).count() == 0


def test_mixing_keeps_expectations(spark):
    docs = spark.createDataFrame(
        [(i, "w " * (1 + i % 5), "ab"[i % 2]) for i in range(60)],
        "doc_id int, text string, source string",
    )
    times = 8
    total = sum(
        mixing.mix_plan(docs, weights=(1, 3), seed=100 * k, leaf=8)
        .where("source = 'a'").agg(F.sum("copies")).first()[0]
        for k in range(times)
    )
    plan = mixing.mix_plan(docs, weights=(1, 3), leaf=8).where("source = 'a'").first()
    expected = plan.target / plan.source_size * 30
    assert abs(total / times - expected) < 2.5


# 3


def test_decontamination(spark, sf_dir, documents, odd, odd_docs, none):
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    got = rows(QUERIES["op3_decontaminate"](spark, sf_dir), *names)
    expected = brute.contamination(documents, read(sf_dir, "benchmark", "item_id", "text"))
    assert got == expected
    assert any(r[5] for r in got)
    items = spark.createDataFrame(ITEMS, "item_id int, text string").withColumn("row", F.lit(1))

    def found(docs, bench):
        return rows(
            decontaminate.hits(docs, bench).select(
                "doc_id", "n_words", "n_hit", F.size("items").cast("long"),
                F.sha2(F.array_join("items", ","), 256), F.col("n_hit") > 0,
            )
        )

    assert found(odd, items) == brute.contamination(pairs(odd_docs), ITEMS)
    assert found(odd, items.limit(0)) == brute.contamination(pairs(odd_docs), [])
    assert found(none, items) == []
    clean = decontaminate.drop_contaminated(odd, items)
    assert clean.columns == odd.columns
    expected = [r[0] for r in brute.contamination(pairs(odd_docs), ITEMS) if not r[5]]
    assert sorted(map(str, (r.doc_id for r in clean.collect()))) == sorted(map(str, expected))


def test_decontamination_in_blocks(spark, odd, odd_docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 40)
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    got = rows(decontaminate.hits(odd, items).select("doc_id", "n_words", "n_hit", "items"))
    expected = brute.contamination(pairs(odd_docs), ITEMS)
    assert [(d, w, h, brute.sha(",".join(i))) for d, w, h, i in got] == [
        (d, w, h, s) for d, w, h, _, s, _ in expected
    ]


# 4


def test_scores(spark, sf_dir, documents):
    got = QUERIES["op4_hidden_markov"](spark, sf_dir).collect()
    check = sorted(
        ((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got),
        key=str,
    )
    for a, b in zip(check, brute.base_scores(documents), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-5)
    # Texts never seen are likelier under the model than under word frequencies.
    unseen = [r for r in got if r.held_out]
    assert sum(r.score for r in unseen) > sum(r.base_score for r in unseen) * 0.97
    assert all(r.score < 0 for r in got)


def test_scores_odd(odd, odd_docs, none):
    got = sorted(
        (
            (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score)
            for r in hmm.score(odd, states=2, rounds=1).collect()
        ),
        key=str,
    )
    for a, b in zip(got, brute.base_scores(pairs(odd_docs)), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-5)
    assert hmm.score(none, states=2, rounds=1).count() == 0


def test_scores_without_training_rows(spark):
    """All documents are held out: one constant, and training ends."""
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:12]
    docs = spark.createDataFrame([(i, f"a b {i}") for i in held], "doc_id long, text string")
    got = hmm.score(docs, states=2).collect()
    assert len(got) == 12
    assert {(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(True, 4, 0, 0)}
    assert all(r.base_score == 0 and abs(r.score) < 1e-9 for r in got)


def test_training_settles_or_says_so(spark, odd, monkeypatch):
    monkeypatch.setattr(hmm, "MOST_ROUNDS", 3)
    with pytest.warns(UserWarning, match="not settled"):
        assert hmm.score(odd, states=2).count() == odd.count()
    monkeypatch.setattr(hmm, "TOLERANCE", 0.5)
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert hmm.score(odd, states=2).count() == odd.count()


def test_rare_words_have_emissions_of_their_own(spark, monkeypatch):
    """Words beyond the broadcast ones tell the state, too, however many they are."""
    import random

    rng = random.Random(1)
    kinds = [[f"{k}{i}" for i in range(20_000)] for k in "ab"]
    docs = [(i, " ".join(rng.choices(kinds[i % 2], k=800))) for i in range(400)]
    monkeypatch.setattr(hmm, "FREQUENT", 1000)
    got = hmm.score(spark.createDataFrame(docs, "doc_id long, text string"), states=2).collect()
    gain = [(r.score - r.base_score) / r.n_tokens for r in got if r.held_out]
    # A word seen c times in one kind of text and never in the other: log10((2c + 1) / (c + 1)).
    assert len(got) == 400 and sum(gain) / len(gain) > 0.2


def test_training_keeps_two_rounds_of_counts(spark, monkeypatch, tmp_path):
    """However many rounds it takes, and the session's settings stay."""
    from netvigil.llm import common

    named = iter(range(1000))
    for module in (common, hmm):
        monkeypatch.setattr(
            module, "work_path", lambda _, label: str(tmp_path / f"{label}-{next(named)}"), raising=False
        )
    docs = spark.createDataFrame(
        [(i, f"a{i % 7} b{i % 5} c{i % 3} d") for i in range(60)], "doc_id long, text string"
    )
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.getAll
    got = hmm.score(docs, states=2, rounds=4)
    assert len(list(tmp_path.glob("hmm-expected-*"))) == 2
    assert got.count() == 60
    assert (dict(spark.sparkContext.getConf().getAll()), spark.conf.getAll) == before


def test_training_exchanges_packed_numbers(spark, monkeypatch, tmp_path):
    """Symbols take less than 32 bits each, and counts go by block and part, not by word."""
    import random

    from netvigil.llm import common

    named = iter(range(1000))
    for module in (common, hmm):
        monkeypatch.setattr(
            module, "work_path", lambda _, label: str(tmp_path / f"{label}-{next(named)}"), raising=False
        )
    monkeypatch.setattr(hmm, "FREQUENT", 1000)
    rng = random.Random(2)
    kinds = [f"w{i}" for i in range(5000)]
    docs = spark.createDataFrame(
        [(i, " ".join(rng.choices(kinds, k=500))) for i in range(100)], "doc_id long, text string"
    )
    got = hmm.score(docs, states=2, rounds=2).collect()
    encoded = spark.read.parquet(str(next(tmp_path.glob("hmm-encoded-*"))))
    size = encoded.selectExpr("sum(octet_length(symbols))").first()[0]
    assert size < 3 * sum(r.n_tokens for r in got) == 3 * 100 * 501
    blocks = encoded.select("block").distinct().count()
    for path in tmp_path.glob("hmm-expected-*"):
        assert spark.read.parquet(str(path)).count() < 8 * blocks + 200 < len(kinds)


def _small_model(seed):
    import numpy as np

    random = np.random.default_rng(seed)
    start, move = random.dirichlet([1, 1, 1]), random.dirichlet([1, 1, 1], 3)
    emit = np.zeros((hmm.CLASSES, 3))
    emit[:6] = random.dirichlet([1] * 6, 3).T
    return hmm.Model(start, move, emit)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=6), min_size=1, max_size=6))
def test_likelihood_and_expectations_by_all_paths(texts):
    """Against the sum over all state paths."""
    import itertools

    import numpy as np

    m = _small_model(1)
    lanes = hmm.Lanes([np.array(t, np.uint16) for t in texts])
    starts, moves, emitted = np.zeros(3), np.zeros((3, 3)), np.zeros((3, hmm.CLASSES))
    for t, log in zip(texts, lanes.log_likelihoods(m), strict=True):
        total, s, mv, e = 0.0, np.zeros(3), np.zeros((3, 3)), np.zeros((3, hmm.CLASSES))
        for path in itertools.product(range(3), repeat=len(t)):
            p = m.start[path[0]] * m.emit[t[0], path[0]]
            for i in range(1, len(t)):
                p *= m.move[path[i - 1], path[i]] * m.emit[t[i], path[i]]
            total += p
            s[path[0]] += p
            for i, z in enumerate(path):
                e[z, t[i]] += p
                if i:
                    mv[path[i - 1], z] += p
        assert log == pytest.approx(np.log10(total))
        starts, moves, emitted = starts + s / total, moves + mv / total, emitted + e / total
    got = lanes.expectations(m)
    for a, b in zip(got, (starts, moves, emitted), strict=True):
        assert np.allclose(a, b)


# 5


def check_shards(got, n, shards=8):
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(got) == n
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    counts = [len(by[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1


def test_sharding(spark, sf_dir, odd, odd_docs, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = QUERIES["op5_shard"](spark, sf_dir)
    check_shards(got.collect(), docs.count())
    for size in (4096, 2):
        out = sharding.shard(odd, 8, bucket_rows=size)
        check_shards(out.collect(), len(odd_docs))
        assert sorted(out.columns) == sorted(odd.columns)
    assert rows(out, "doc_id", "shard", "slot") == rows(
        sharding.shard(odd.repartition(5), 8, bucket_rows=2), "doc_id", "shard", "slot"
    )
    assert sharding.shard(none).count() == 0


def test_matrix_is_exact(spark):
    """Margins hold, and counts follow the hypergeometric law."""
    counts = spark.createDataFrame([(0, 6), (1, 4), (3, 5)], "bucket bigint, row_count bigint")
    for seed in range(3):
        m = sharding.communication_matrix(counts, 2, 3, seed).collect()
        assert {r.bucket: sum(r.takes) for r in m} == {0: 6, 1: 4, 2: 0, 3: 5}
        assert [sum(r.takes[k] for r in m) for k in range(3)] == [5, 5, 5]
    draws = spark.range(4000).select(
        sharding._hypergeometric(
            sharding.uniform(F.lit(1), "id"),
            *[F.lit(x).cast("long") for x in (15, 5, 6)],
        ).alias("k")
    )
    seen = {r.k: r["count"] for r in draws.groupBy("k").count().collect()}
    from math import comb

    for k in range(6):
        expected = 4000 * comb(5, k) * comb(10, 6 - k) / comb(15, 6)
        assert abs(seen.get(k, 0) - expected) < 5 * (expected**0.5 + 1)


# 6


def test_repeats(spark, sf_dir, documents, odd, odd_docs, none):
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    small = [d for d in documents if len(d[1] or "") < 30_000]
    table = spark.createDataFrame(small, "doc_id bigint, text string").repartition(5)
    assert rows(repeats.removed(table), *names) == brute.repeats(small)
    assert rows(repeats.removed(odd), *names) == brute.repeats(pairs(odd_docs))
    assert repeats.removed(none).count() == 0


def test_repeats_in_other_blocks(odd, odd_docs, monkeypatch):
    """Results don't depend on the width or on how distances are cut into blocks."""
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows(repeats.removed(odd, 64), *names) == brute.repeats(pairs(odd_docs), 64)
    monkeypatch.setattr(repeats, "BLOCKS", (7, 1))
    assert rows(repeats.removed(odd), *names) == brute.repeats(pairs(odd_docs))


def test_repeats_in_a_group_of_near_copies(spark):
    """Each copy has edits of its own; some are repeated in full."""
    random = Random(7)
    base = "".join(random.choices("abcdefgh ", k=1500))
    docs = []
    for i in range(120):
        text = list(base)
        for at in random.sample(range(len(base)), i % 4):
            text[at] = chr(0x4E00 + i)
        docs.append((i, "".join(text)))
    docs += docs[5:8] * 3
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert rows(repeats.removed(table), *names) == brute.repeats(docs)


def test_phrases_of_pieces_agree(odd_docs, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 300)
    texts = [(t or "").encode() for _, t, *_ in odd_docs]
    for data, starts, ends, row, offset in repeats._chunks(texts, 200):
        p = repeats.Phrases(data, starts, ends, 200)
        covered = sum(p.end - p.start)
        assert covered == sum(max(0, e - s - 199) for s, e in zip(starts, ends, strict=True))
        for s, e, r, o in zip(starts, ends, row, offset, strict=True):
            assert data[s:e].tobytes() == texts[r][o : o + e - s]


# 7


def test_jaccard(spark, sf_dir, documents, odd, odd_docs, none):
    names = ("doc_id", "n_shingles", "component_id")
    got = rows(QUERIES["op7_jaccard_join"](spark, sf_dir), *names)
    assert got == brute.jaccard(documents)
    with_id = odd.where("doc_id IS NOT NULL")
    expected = brute.jaccard([p for p in pairs(odd_docs) if p[0] is not None])
    assert rows(jaccard.jaccard_components(with_id), *names) == expected
    assert jaccard.jaccard_components(odd).count() == len(odd_docs)
    assert jaccard.jaccard_components(none).count() == 0
    kept = jaccard.one_per_group(with_id)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _, c in expected if d == c}


def test_one_row_of_each_group_stays(spark, odd, none):
    """Repeated rows, rows without id, and two texts under one id."""
    words = [f"w{i}" for i in range(120)]
    base, near = " ".join(words), " ".join([*words[:-1], "other"])
    lone, left = " ".join(f"x{i}" for i in range(80)), " ".join(f"y{i}" for i in range(80))
    table = [(5, base), (5, base), (5, base), (7, near), (None, base), (7, lone), (8, lone)]
    table += [(None, left), (None, left), (3, None), (3, None), (4, ""), (9, near)]
    docs = spark.createDataFrame(table, "doc_id long, text string").withColumn("group", F.lit("clash"))
    kept = jaccard.one_per_group(docs.repartition(3), size=5, percent=80)
    assert kept.columns == docs.columns
    assert rows(kept, "doc_id", "text") == sorted(
        [(5, base), (7, lone), (None, left), (3, None), (3, None), (4, "")], key=str
    )
    assert jaccard.one_per_group(none).count() == 0
    assert jaccard.one_per_group(odd).count() < odd.count()


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_last_pairs_of_lists_lose_no_pair(spark, percent):
    """Every pair of entries that the bounds allow, whatever its size and position."""
    import random

    rng = random.Random(percent)
    lists = []
    for token in range(6):
        for c in range(40):
            n = rng.choice([1, 2, 3, 9, 10, 11, 99, 100, rng.randrange(1, 400)])
            pos = rng.randrange(n - -(-percent * n // 100) + 1)
            lists.append((token, 100 * token + c, n, pos, rng.randrange(4)))
    table = spark.createDataFrame(lists, "token long, class long, n int, pos int, label long")
    sizes = collections.Counter((t, x) for t, _, _, _, x in lists)
    top = {t: max((sizes[t, x], x) for x in range(4))[1] for t in range(6)}
    expected = set()
    for t, a, na, pa, x in lists:
        for u, b, nb, pb, y in lists:
            if t == u and x != y and x != top[t]:
                best = min(na - pa, nb - pb)
                if 100 * min(na, nb) >= percent * max(na, nb) and (100 + percent) * best >= percent * (na + nb):
                    expected.add((min(a, b), max(a, b)))
    got = {tuple(r) for r in jaccard._last_pairs(table, percent).select("a", "b").collect()}
    assert got == expected


def test_near_copies_that_do_not_link_are_not_listed_by_twos(spark, monkeypatch):
    """60 texts, any two about 0.7 alike, and a copy of one: the copy links, and few pairs are listed."""
    import random

    rng = random.Random(3)
    base = [f"w{i}" for i in range(400)]
    texts = []
    for c in range(60):
        changed = set(rng.sample(range(400), 14))
        texts.append([f"x{c}-{i}" if i in changed else w for i, w in enumerate(base)])
    texts.append([*texts[30][:-1], "other"])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    listed = []
    kept = jaccard.stored

    def counted(df, label):
        found = kept(df, label)
        if label == "jaccard-pairs":
            listed.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "stored", counted)
    got = rows(jaccard.jaccard_components(docs, size=5, percent=80), "doc_id", "component_id")
    assert got == sorted([*((i, i) for i in range(60)), (60, 30)], key=str)
    assert listed[-1] < 60


def test_pairs_of_entries_that_share_lists_are_met_in_the_first(spark):
    """Three classes in the same eight lists: a pair is listed once per side and block of positions."""
    table = spark.createDataFrame(
        [(token, c, 100, token, c) for token in range(8) for c in range(3)],
        "token long, class long, n int, pos int, label long",
    )
    assert rows(jaccard._last_pairs(table, 80), "a", "b") == [(0, 1), (0, 2), (1, 2)]
    assert jaccard._listed(table, 80).count() <= 8


# 8


def test_lines(spark, sf_dir, documents, odd, odd_docs, none):
    names = ("doc_id", "n_lines", "n_dropped", "kept_sha256")
    got = rows(QUERIES["op8_line_dedup"](spark, sf_dir), *names)
    assert got == brute.line_dedup(documents)
    for batches, fanout in ((1, 2), (5, 2)):
        out = lines.dedup_lines(odd, batches, fanout)
        out = out.withColumn("kept_sha256", F.sha2("clean_text", 256))
        assert rows(out, *names) == brute.line_dedup(pairs(odd_docs))
    assert lines.dedup_lines(none).count() == 0


# 9


def greedy(word, pieces):
    n = 0
    while word:
        for k in range(len(word), 0, -1):
            if word[:k] in pieces:
                break
        else:
            return -1
        word, n = word[k:], n + 1
    return n


@settings(max_examples=200, deadline=None)
@given(
    st.sets(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12),
    st.sets(st.text("abc", min_size=1, max_size=5), max_size=12),
    st.text("abcd", max_size=14),
)
def test_automaton(start, rest, word):
    start, rest, word = {s.encode() for s in start}, {s.encode() for s in rest}, word.encode()
    assert wordpiece.Automaton(start).length(word) == greedy(word, start)
    first = next((word[:k] for k in range(len(word), 0, -1) if word[:k] in start), None)
    tail = greedy(word[len(first) :], rest) if first is not None else -1
    expected = 0 if not word else tail + 1 if tail >= 0 else -1
    assert wordpiece.Automaton(start, rest).length(word) == expected


def test_token_counts(spark, sf_dir, documents, odd, odd_docs, none):
    pieces = set(wordpiece.read_ranks(VOCABULARY))

    def expected(docs):
        out = []
        for doc, text in docs:
            ws = (text or "").encode().split()
            out.append((doc, len(ws), sum(greedy(b" " + w, pieces) for w in ws), 0))
        return sorted(out, key=str)

    assert rows(QUERIES["op9_token_counts"](spark, sf_dir)) == expected(documents)
    automaton = wordpiece.Automaton(pieces)
    assert rows(wordpiece.count_tokens(odd, automaton, b" ")) == expected(pairs(odd_docs))
    assert wordpiece.count_tokens(none, automaton).count() == 0
    few = wordpiece.count_tokens(odd, wordpiece.Automaton([b"one"]))
    assert {(r.n_tokens, r.n_unknown) for r in few.where("n_words = 1").collect()} >= {(1, 0), (1, 1)}


# 10


def test_quality(spark, sf_dir, documents, odd, odd_docs, none):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
             "base_failed")
    got = QUERIES["op10_quality_rules"](spark, sf_dir)
    assert rows(got, *names) == brute.quality(documents)
    verdicts = got.collect()
    assert not any(r.kept and r.base_failed for r in verdicts)
    measured = quality.measure_documents(odd)
    out = quality.judged(measured, quality.thresholds(measured))
    flat = out.select(
        "doc_id", *[F.col("m")[n].alias(n) for n in names[1:6]], "base_failed", "kept"
    )
    assert rows(flat, *names) == brute.quality(pairs(odd_docs))
    kept = quality.keep_good(odd)
    assert kept.columns == odd.columns
    assert rows(kept, "doc_id") == rows(flat.where("kept"), "doc_id")
    assert quality.keep_good(none).count() == 0


def test_quality_keeps_good_documents(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = QUERIES["op10_quality_rules"](spark, sf_dir).join(labels, "doc_id")
    table = {
        (r.quality, r.kept): r["count"]
        for r in found.where("n_words >= 50").groupBy("quality", "kept").count().collect()
    }
    good, bad = (table.get((1, k), 0) for k in (True, False))
    assert bad <= 0.005 * (good + bad)
    assert table.get((0, True), 0) <= 0.02 * table.get((0, False), 0)


def _measured(spark, n, junk):
    """Measures of n documents of one source, the given share of them junk in all measures."""
    i = F.col("id")
    bad = i % 100 < junk
    m = {
        "n_words": F.lit(1000),
        "word_chars": F.when(bad, 9000).otherwise(4700 + i % 700),
        "n_symbols": F.when(bad, 2700).otherwise(i % 40),
        "n_lines": F.lit(100),
        "n_dup_lines": F.when(bad, 70).otherwise(i % 7),
        "n_repeat_words": F.when(bad, 450).otherwise(i % 50),
    }
    return spark.range(n).select(
        F.lit("en").alias("lang"),
        F.lit("a").alias("source"),
        F.struct(*[v.cast("long").alias(k) for k, v in m.items()]).alias("m"),
        bad.alias("bad"),
    )


@pytest.mark.parametrize("junk", [0, 30, 40, 50])
def test_quality_of_a_source_with_much_junk(spark, junk):
    measured = _measured(spark, 10_000, junk)
    fences = quality.thresholds(measured)
    found = quality.judged(measured, fences).groupBy("bad", "kept").count().collect()
    assert {(r.bad, r.kept) for r in found} == {(False, True), (True, False)} - (
        set() if junk else {(True, False)}
    )
    # Each measure rejects by itself, repeats below the base rule's 0.5.
    fence = fences.first().fences
    assert fence["symbols"] < 0.3 and fence["dup_lines"] < 0.7
    assert fence["repeats"] < 0.45 and fence["word_length"] < 9


def test_quality_fences_do_not_switch_with_the_size_of_a_source(spark):
    small = _measured(spark, 100, 0).select(
        "lang",
        F.explode(F.array(F.lit("99"), F.lit("100"))).alias("source"),
        F.col("m").withField("n_symbols", 800 + F.col("m.n_symbols")).alias("m"),
    )
    less = small.where("source = '99'").limit(99).unionByName(small.where("source = '100'"))
    measured = less.unionByName(_measured(spark, 10_000, 0).drop("bad"))
    fences = quality.thresholds(measured)
    by = {r.source: r.fences["symbols"] for r in fences.collect()}
    assert by["99"] == pytest.approx(by["100"], rel=0.02)
    found = quality.judged(measured, fences).groupBy("source").agg(F.min("kept").alias("all"))
    assert all(r["all"] for r in found.collect())
