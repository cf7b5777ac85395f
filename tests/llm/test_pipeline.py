"""The pipeline stage by stage and as a whole, against plain versions."""

import collections

import brute
import pytest

import corpus_pipeline
from netvigil.llm import quality


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """What ``run`` gives to its first stage and gets from each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen, stored = [docs.collect()], corpus_pipeline.stored

    def noted(df, label):
        out = stored(df, label)
        seen.append(out.collect())
        return out

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline, "stored", noted)
        out = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(str, out.collect())) == sorted(map(str, seen[-1]))
    assert len(seen) == len(corpus_pipeline.STAGES) + 1
    assert all(list(rows[0].asDict()) == docs.columns for rows in seen[:-1])
    return seen


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_quality_stage(spark, sf_dir, stages):
    base = brute.quality([(r.doc_id, r.text) for r in stages[0]])
    failed = {r[0] for r in base if r[-1]}
    assert failed and not failed & set(ids(stages[1]))
    measured = quality.measure_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept = quality.judged(measured, quality.thresholds(measured)).where("kept").collect()
    assert ids(stages[1]) == ids(kept)


def test_jaccard_stage(stages):
    groups = brute.jaccard([(r.doc_id, r.text) for r in stages[1]], 80, 5)
    assert ids(stages[2]) == sorted(doc for doc, _, least in groups if doc == least)
    assert len(stages[2]) < len(stages[1])


def test_decontamination_stage(spark, sf_dir, stages):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()
    hits = brute.contamination([(r.doc_id, r.text) for r in stages[2]], [tuple(i) for i in items])
    assert ids(stages[3]) == sorted(r[0] for r in hits if not r[-1])
    assert len(stages[3]) < len(stages[2])


def test_mixing_stage(stages):
    words = {r.doc_id: len(brute.WORD.findall(r.text or "")) for r in stages[3]}
    source = {r.doc_id: r.source for r in stages[3]}
    sizes, taken, largest = (collections.Counter() for _ in range(3))
    for doc, n in words.items():
        sizes[source[doc]] += n
        largest[source[doc]] = max(largest[source[doc]], n)
    copies = collections.Counter(r.doc_id for r in stages[4])
    assert set(copies) <= set(words) and max(copies.values()) <= 2
    for doc, n in copies.items():
        taken[source[doc]] += n * words[doc]
    for s, target in brute.targets(sizes).items():
        assert abs(taken[s] - target) <= largest[s]


def test_sharding_stage(stages):
    assert ids(stages[5]) == ids(stages[4])
    slots = collections.defaultdict(list)
    for r in stages[5]:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(slots[s]) for s in range(corpus_pipeline.SHARDS)]
    assert max(counts) - min(counts) <= 1
