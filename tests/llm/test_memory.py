"""What a task holds: one Python worker where one is enough, and bounded Arrow batches."""

from larkdoc.llm import fingerprints, queries
from larkdoc.plans import tables


def test_fingerprints_are_made_and_compared_in_one_worker(spark, sf_dir):
    limit = spark.conf.get(tables.BATCHES)
    try:
        spark.conf.set(tables.BATCHES, "64MB")
        made = queries.op1_fingerprints(spark, sf_dir)
        assert int(spark.conf.get(tables.BATCHES).removesuffix("b")) <= tables.BATCH_BYTES
        last = made._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]
        assert "MapInArrow" in last and "ArrowEvalPython" not in last
        names = ["doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        rows = made.orderBy("doc_id").select(*names).collect()
    finally:
        spark.conf.set(tables.BATCHES, limit)
    # the column functions say the same of the same texts
    docs = fingerprints.document_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).orderBy("doc_id").collect()
    pairs = spark.createDataFrame([(a["doc_id"], a["fingerprint"], b["fingerprint"]) for a, b in zip(docs, docs[1:] + docs[:1], strict=True)], "doc_id long, a binary, b binary")
    said = pairs.select("doc_id", fingerprints.as_string("a").alias("a"), fingerprints.likeness_of("a", "b").alias("near")).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["fingerprint"], r["near_next"]) for r in rows] == [tuple(r) for r in said]
