"""An embedder gets a bounded number of texts at a time, and each text's vector stays with it."""

from pyspark.sql import functions as F

from larkdoc.operators import vectors


def test_embedders_get_bounded_pieces(spark):
    embed = vectors.embed_with(lambda: lambda texts: [[len(texts), len(t)] for t in texts])
    docs = spark.range(0, 3000, 1, 1).select("id", F.when(F.col("id") % 7 != 0, F.expr("repeat('a', int(id % 50))")).alias("text"))
    found = docs.select("id", embed("text").alias("v")).collect()
    assert sorted(r["id"] for r in found) == list(range(3000))
    assert all(r["v"][1] == (r["id"] % 50 if r["id"] % 7 else 0) for r in found)
    assert max(r["v"][0] for r in found) <= 256
    assert docs.limit(0).select(embed("text")).collect() == []
