"""The stages one after the other on a small corpus, each against what it must do to its own input."""

import random

import helpers as h

import corpus_pipeline
from quillgraph.llm import decontaminate, simhash


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    plain = ["good", "plain", "day", "tree", "river", "stone", "light", "house", "under", "walk"]
    text = lambda n: " ".join(rng.choice(plain) + rng.choice(["s", "ed", "er", "ly", ""]) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        toxic = i % 4 == 0
        rows.append((i, text(60) + (" vile" if toxic else "")))
        labels.append((i, int(toxic)))
    passage, item = text(80), text(30)
    rows += [(1000, text(200) + passage), (1001, passage + text(200)), (1003, text(60) + " " + item + " " + text(60)), (None, text(30)), (1009, None), (1010, "")]
    rows += [(1100, rows[1][1]), (1101, rows[2][1])]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    h.table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    base = f"file://{tmp_path}"
    docs, seen = spark.read.parquet(f"{base}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, base)
        if k < 4:
            assert out.columns == docs.columns, name
        out.write.parquet(f"{base}/stage{k}")
        docs = spark.read.parquet(f"{base}/stage{k}")
        seen.append(docs)
    ids = [{r[0] for r in s.select("doc_id").collect()} for s in seen]
    assert not any(i % 4 == 0 for i in ids[0] if i is not None and i < 300) and len(ids[0]) > 220
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(seen[0]).collect() if r["doc_id"] is not None}
    assert ids[1] == {d for d, c in groups.items() if d == c} | {None}
    assert 1100 not in ids[1] and 1101 not in ids[1] and ids[2] == ids[1]
    after = {r["doc_id"]: r["text"] for r in seen[2].collect()}
    assert passage[20:-20] in after[1000] and passage[20:-20] not in after[1001]
    leaked = {r["doc_id"] for r in decontaminate.find(seen[2], spark.read.parquet(f"{base}/benchmark.parquet")).collect()}
    assert 1003 in leaked and ids[3] == ids[2] - leaked
    assert {r[0] for r in seen[4].select("doc_id").collect()} == ids[3]
    assert corpus_pipeline.run(spark, base).count() == seen[4].count()
