"""Operators leave the session's settings as they were."""

import helpers as h

from quillgraph.llm import decontaminate, dedup, lm_scoring, packing, simhash, token_counts, token_files, toxicity, warc
from quillgraph.llm.common import tokenizer_path
from quillgraph.plans import scratch

WORD, BYTE = tokenizer_path("word_bpe_49k.json"), tokenizer_path("byte_bpe_50k.json")


def test_settings_stay(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "777")
    try:
        before = {r["key"]: r["value"] for r in spark.sql("SET").collect()}
        df = h.table(spark, h.texts(1, 5)[:8])
        labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
        toxicity.score(df, toxicity.fit(df, labels)).count()
        dedup.remove_repeats(df).count()
        path = scratch.new_path(spark, "session")
        token_files.write(df, path, WORD)
        token_files.read(spark, path).count()
        lm_scoring.score(df).count()
        token_counts.count_tokens(df, BYTE).count()
        decontaminate.find(df, spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count()
        packing.pack(df, WORD).count()
        warc.write_warc(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), f"file://{tmp_path}/w")
        warc.read_warc(spark, f"file://{tmp_path}/w").count()
        simhash.near_duplicates(df).count()
        simhash.similar_groups(df).count()
        assert {r["key"]: r["value"] for r in spark.sql("SET").collect()} == before
    finally:
        spark.conf.unset(key)
