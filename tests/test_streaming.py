from evidra.sources import text
from evidra.streaming import blocks


def test_stream_gives_the_batch_result(spark, tmp_path):
    schema = "id long, text string"
    stream = blocks.block_stream(spark, str(tmp_path / "in"), schema, "id", "text") if (tmp_path / "in").mkdir() is None else None
    for k in range(2):
        spark.createDataFrame([(k, f"a{k}\n\nb")], schema).write.mode("append").parquet(str(tmp_path / "in"))
        blocks.keep_blocks(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    want = text.line_blocks(spark.read.schema(schema).parquet(str(tmp_path / "in")), "id", "text").collect()
    got = spark.read.parquet(str(tmp_path / "out")).select("id", "ord", "anchor", "kind", "text", "disposition").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) == 6
