"""Keyed state of live frames: changes, snapshot and what subscribers still get."""

import random

from massflow.streaming import live

SCHEMA = "sim string, context int, coordinates int, arrival long, value double"


def test_state_stream_equals_the_batch_table(spark, tmp_path):
    live.use_rocksdb(spark)
    rng = random.Random(2)
    rows = [("s", k % 2, rng.randrange(12), k, rng.random()) for k in range(300)]
    parts = [rows[:100], rows[150:300], rows[100:150], [("s", 0, 99, None, 1.0)]]  # one part late, one without an arrival
    src, out, ck = (str(tmp_path / k) for k in ("in", "out", "ck"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(src)
    sizes, seen = [], []
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).write.parquet(f"{src}/{k}")
        live.state_stream(stream, out, ck).awaitTermination()
        seen += part
        want = live.latest(spark.createDataFrame([r for r in seen if r[3] is not None], SCHEMA))
        columns = ["sim", "context", "coordinates", "arrival", "value", "place"]
        expected = sorted(map(tuple, want.select(*columns).collect()))
        assert sorted(map(tuple, live.snapshot(spark, ck).select(*columns).collect())) == expected
        assert sorted(map(tuple, live.latest_change(spark.read.parquet(out)).select(*columns).collect())) == expected
        got = sorted(map(tuple, live.since(spark, out, 120).select(*columns).collect()))
        assert [r[:5] for r in got] == [r[:5] for r in expected if r[3] > 120]
        sizes.append(spark.read.parquet(out).count())
    # A batch adds changes of its own keys only.
    assert sizes[0] <= 24 and sizes[1] - sizes[0] <= 24 and sizes[3] == sizes[2]
