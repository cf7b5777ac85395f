import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def odd_docs():
    """(doc_id, text, lang, source): nulls, empty and long texts, ties, copies and near copies."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(400)]

    def prose(n):
        words = [w + rng.choice(["", "", "", ".\n", ","]) for w in rng.choices(vocabulary, k=n)]
        return " ".join(words)

    base = prose(400)
    words = base.split(" ")
    texts = [None, "", " \t ", "one", "One two", "a\nb", "x" * 950, "ab" * 300, base, base, base]
    for i in range(12):
        copy = list(words)
        for _ in range(i):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    shared = prose(60)
    texts += [f"{prose(30)} {shared} {prose(20)}" for _ in range(5)]
    texts += [f"{prose(12)}\nThe same line stands here\n{prose(9)}\n" * k for k in (1, 1, 3)]
    texts += [prose(6000), prose(3000).upper(), "### User: \\b </turn>" * 20, "*% # &" * 90]
    texts += [prose(rng.randint(40, 90)) for _ in range(30)]
    langs, sources = ["en", "de", None], ["b", "a", None, "é", "b", "b"]
    rows = [(i * 3, t, langs[i % 3], sources[i % 6]) for i, t in enumerate(texts)]
    rows += [rows[12], rows[8], (None, base, "en", "a"), (None, "ties and nulls", None, None)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_docs):
    """The same as a table, over several partitions, with columns that bear clashing names."""
    schema = "doc_id bigint, text string, lang string, source string"
    rows = spark.createDataFrame(odd_docs, schema).repartition(3)
    clash = "row n key word a b node shard slot copies label class n_lines kept size m".split()
    from pyspark.sql import functions as F

    return rows.withColumns({c: F.lit("clash") for c in clash})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
