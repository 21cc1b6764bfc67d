import numpy as np
from pyspark.sql import functions as F

from patchloom.operators.sampling import reservoir
from patchloom.queries.features import fused_layer
from patchloom.sources.folders import from_array
from patchloom.streaming.images import processed, running_moments, sampled


def test_streams_give_what_tables_give(spark, tmp_path):
    x = np.random.default_rng(0).random((30, 8, 8, 1))
    table = from_array(spark, x)
    for k in range(3):
        table.where(F.col("id") % 3 == k).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = lambda: spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = processed(fused_layer(), stream()).writeStream.format("memory").queryName("pooled").start()
    q.processAllAvailable()
    q.stop()
    want = {r["id"]: r["feature"] for r in fused_layer().process(table).collect()}
    got = {r["id"]: r["feature"] for r in spark.table("pooled").collect()}
    assert got == want
    q = running_moments(stream(), "id").writeStream.outputMode("complete").format("memory").queryName("moments").start()
    q.processAllAvailable()
    q.stop()
    assert tuple(spark.table("moments").first()) == (30, 435.0, sum(i * i for i in range(30)))
    source = stream()
    q = source.writeStream.foreachBatch(sampled(source, 7, "id", str(tmp_path / "kept"))).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {r["id"] for r in spark.read.parquet(str(tmp_path / "kept/2")).collect()} == {r["id"] for r in reservoir(table, 7, "id").collect()}
