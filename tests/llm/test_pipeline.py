from collections import Counter

import corpus_pipeline
from helpers import put

from maskwright.llm import decontaminate, near, toxicity
from maskwright.llm.common import table

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_its_parts(spark, tmp_path):
    docs = table(spark, SF, "documents")
    model = toxicity.fit(docs, table(spark, SF, "labels"))
    left = {r["doc_id"] for r in toxicity.scored(docs, model).collect() if r["score"] < toxicity.CUT}
    kept = {r["doc_id"] for r in near.near_classes(docs.filter(docs["doc_id"].isin(*left))).collect() if r["kept"]}
    clean = {r["doc_id"] for r in decontaminate.leaks(docs.filter(docs["doc_id"].isin(*kept)), table(spark, SF, "benchmark")).collect() if not r["contaminated"]}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in rows} <= clean and len(rows) > 0
    slots = Counter((r["shard"], r["slot"]) for r in rows)
    assert max(slots.values()) == 1 and {r["shard"] for r in rows} == set(range(8))


def test_stages_keep_columns_and_empty_tables(spark, tmp_path):
    docs = table(spark, SF, "documents")
    sf = put(tmp_path, labels=table(spark, SF, "labels").filter("false"), benchmark=table(spark, SF, "benchmark").filter("false"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.filter("false"), sf)
        assert out.columns == docs.columns and out.count() == 0
