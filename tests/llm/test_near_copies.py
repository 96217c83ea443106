"""Near copies against exact Jaccard of all pairs."""

import random

import pyarrow as pa
import pytest

import corpus_pipeline
from feedledger.llm import near_copies, simhash


def copies(spark):
    """Families of texts with some words changed, from near to far, and odd rows."""
    rng, rows = random.Random(3), []
    for family in range(12):
        base = [f"w{rng.randrange(900)}" for _ in range(150 + 20 * family)]
        for member in range(6):
            text = list(base)
            for _ in range(rng.randrange(6)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10_000)}"
            rows.append((100 * family + member, " ".join(text)))
    rows += [(5000, None), (5001, ""), (5002, "One two"), (5003, "one  TWO"), (5004, "one two three"), (None, "one two"), (5002, "else")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def sets(text, words=5):
    parts = (text or "").lower().split()
    return {tuple(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))} if parts else set()


def slow_components(rows, least=0.8):
    named = [(i, sets(t)) for i, t in rows if i is not None]
    root = list(range(len(named)))
    linked = lambda a, b: not a | b or len(a & b) / len(a | b) >= least
    for n, (_, a) in enumerate(named):
        for m, (_, b) in enumerate(named[:n]):
            if root[n] != root[m] and linked(a, b):
                old = root[n]
                root = [root[m] if r == old else r for r in root]
    low = {}
    for r, (i, _) in zip(root, named, strict=True):
        low[r] = min(i, low.get(r, i))
    return sorted((i, low[r]) for r, (i, _) in zip(root, named, strict=True))


@pytest.mark.parametrize("crowd", [32, 2])
def test_components(spark, crowd):
    rows, docs = copies(spark)
    found = near_copies.near_copy_components(docs, crowd=crowd).collect()
    assert len(found) == len(rows)
    assert [r.component_id for r in found if r.doc_id is None] == [None]
    assert sorted((r.doc_id, r.component_id) for r in found if r.doc_id is not None) == slow_components(rows)


def test_stage_drops_copies_down_to_the_rule(spark):
    words = [f"w{i}" for i in range(200)]
    far = words[:]
    for i in (40, 90, 140):  # 15 of 196 shingles differ: similarity 181/211, 0.858
        far[i] = "other"
    further = words[:]
    for i in (20, 60, 100, 140, 180):  # 25 of 196: similarity 171/221, 0.774
        further[i] = f"else{i}"
    rows = [(1, " ".join(words)), (2, " ".join(far)), (3, " ".join(further))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()} == {1, 3}
    assert corpus_pipeline.drop_near_duplicates(spark, docs.where("false"), "").count() == 0


def test_unlinked_crowd_makes_no_more_edges_than_texts(spark):
    rng, rows = random.Random(8), []
    base = [f"w{i}" for i in range(120)]
    for i in range(80):  # six changed words: pairs lie on both sides of 0.8
        text = list(base)
        for at in rng.sample(range(120), 3):
            text[at] = f"x{i}-{at}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = near_copies.near_copy_components(docs, crowd=10).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == slow_components(rows)


def test_long_run_of_a_band_is_joined_to_its_first():
    n = near_copies.COMPARED + 10
    batch = pa.RecordBatch.from_arrays(
        [pa.array([7] * n, pa.int64()), pa.array(range(n), pa.int64()),
         pa.array([bytes(near_copies.SIGNED)] * n, pa.binary())], ["key", "node", "sig"])
    out = [p for b in near_copies._met(iter([batch.slice(0, 50), batch.slice(50)])) for p in b.to_pylist()]
    assert {p["a"] for p in out} == set(range(n)) and {p["b"] for p in out} == {0}


def test_map_columns_do_not_matter(spark):
    docs = spark.createDataFrame([(1, "a b", {"k": 1}), (2, "a  B", None), (3, "c", {})],
                                 "doc_id long, text string, Node map<string,int>")
    assert {r.doc_id for r in near_copies.drop_near_copies(docs).collect()} == {1, 3}


def test_fingerprints_within_the_radius_meet_without_bands(spark, monkeypatch):
    base = [f"w{i}" for i in range(1200)]
    changed = [*base[:200], "other", *base[201:]]
    rows = [(1, " ".join(base)), (2, " ".join(changed)), (3, "One two"), (4, "one  two"), (5, " ".join(base[:100])),
            (6, " ".join(["r s t u v w"] * 9)), (7, " ".join(["r s t u v w"] * 10)), (None, "one two"), (8, None)]
    prints = [simhash.fingerprint(t, 5) for _, t in rows]
    assert (prints[0] ^ prints[1]).bit_count() <= 4 < (prints[0] ^ prints[4]).bit_count()

    def no_bands(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])

    monkeypatch.setattr(near_copies, "_met", no_bands)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = near_copies.near_copy_components(docs).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 6, 7: 6, 8: 8, None: None}
