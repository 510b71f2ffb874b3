"""Streams whose keys share states: as many states as buckets, each key's own results."""

from pyspark.sql import functions as F

from larkdoc.streaming import state


def test_keys_share_states_and_keep_their_own_results(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(state, "BUCKETS", 4, raising=False)
    rows = [(i, None if i % 97 == 0 else i % 97, float(i * 7 % 300 + (i >= 400) * 400), i) for i in range(800)]
    asked = spark.createDataFrame(rows, "ask_id long, key long, at double, n int")
    for k, part in enumerate((asked.where("n < 400"), asked.where("n >= 400"))):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    source = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/part=*")
    said = lambda df: df.select(F.col("ask_id").alias("message_id"), F.col("key").alias("chat_id"), "at", (F.col("n") % 2 == 0).alias("ambiguous"), (F.col("n") % 3 == 0).alias("selects"))
    limited = lambda df: df.select(F.col("ask_id").alias("event_id"), "key", F.timestamp_seconds("at").alias("ts"))
    kinds = {
        "limits": (state.rate_limit_stream(limited(source), 2, 900.0), state.rate_limit(limited(asked), 2, 900.0)),
        "memos": (state.answer_memo_stream(source, 900.0), state.answer_memo(asked, 900.0)),
        "replies": (state.pending_scopes_stream(said(source), 900.0), state.pending_scopes(said(asked), 900.0)),
    }
    for name, (stream, batch) in kinds.items():
        query = stream.writeStream.format("memory").queryName(f"shared_{name}").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        query.awaitTermination()
        assert 1 <= query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4
        found = sorted(map(tuple, spark.table(f"shared_{name}").collect()))
        assert len(found) == 800 and found == sorted(map(tuple, batch.collect()))
