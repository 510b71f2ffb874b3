"""Names of documents are made once, however often they are read."""

from pyspark.sql import functions as F

from larkdoc.operators import workspace


def test_names_and_questions_are_made_once(spark):
    named, said = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def name(i):
        named.add(1)
        return f"Report {i}.txt"

    @F.udf("string")
    def question(i):
        said.add(1)
        return f"what is in report {i} txt and document {i + 2}"

    space = [F.lit("u").alias("username"), F.lit("c").alias("chat_id")]
    documents = spark.range(1, 31).select(*space, F.col("id").cast("int").alias("upload_index"), name("id").alias("name"))
    asked = spark.range(1, 9).select(F.col("id").alias("qid"), *space, question("id").alias("question"))
    found = {tuple(r) for r in workspace.select_documents(asked, documents).collect()}
    assert found == {(i, j) for i in range(1, 9) for j in (i, i + 2)}
    assert (named.value, said.value) == (30, 8)
