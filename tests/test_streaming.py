"""The stream operators on a stream give the batch result."""

import uuid

from wickwork.sources.bars import trades
from wickwork.streaming import bars as streaming


def test_stream_equals_batch(spark, tiny, tmp_path):
    t = trades(spark, tiny)
    t.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "trades"))
    s = spark.readStream.schema(t.schema).parquet(str(tmp_path / "trades"))
    name = "bars_" + uuid.uuid4().hex
    q = streaming.tumbling(s).writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = spark.table(name).toPandas().sort_values(["symbol", "start"]).reset_index(drop=True)
    want = streaming.tumbling(t).toPandas().sort_values(["symbol", "start"]).reset_index(drop=True)
    assert got.round(6).equals(want.round(6))
