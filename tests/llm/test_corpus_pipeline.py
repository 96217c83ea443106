"""The pipeline's stages on a small table, one after the other."""

from collections import Counter

import corpus_pipeline
from feedledger.llm import language, mixing, pii, simhash


def test_stages(spark, docs, tmp_path):
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, seen = seen, stage(spark, seen, folder)
        assert seen.columns == docs.columns
        path = f"{folder}/{name}"
        seen.write.parquet(path)
        seen = spark.read.parquet(path)
        ids = Counter(r.doc_id for r in seen.collect())
        if name == "language":
            gone = {r.doc_id for r in before.collect()} - set(ids)
            assert gone == {301, 302, 303, 308, *({306} - set(ids))}
        elif name == "near_duplicates":
            assert max(ids.values()) == 1 and not {200, 201, 205} & set(ids)
        elif name == "pii":
            assert ids == Counter(r.doc_id for r in before.collect())
            assert all(not r.pii_spans for r in pii.find_pii(seen).collect())
        else:
            plan = mixing.plan_mix(before).collect()
            assert ids == +Counter({r.doc_id: len(r.places) for r in plan})
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {p.doc_id for p in pieces} == set(ids)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "pii", "mixing", "packing"]
