"""Streams over a table that is one file or a folder of files."""

import random

from rampart.plans import registry_extra as RX


def _table(spark, path, files):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(64)], i % 10) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    df.repartition(files).write.parquet(path)


def test_streams_of_files_and_folders(spark, tmp_path):
    import os

    _table(spark, str(tmp_path / "one"), 1)
    file = next(f for f in os.listdir(tmp_path / "one") if f.endswith(".parquet"))
    os.makedirs(tmp_path / "file")
    os.link(tmp_path / "one" / file, tmp_path / "file" / "embeddings.parquet")
    _table(spark, str(tmp_path / "folder" / "embeddings.parquet"), 3)
    for query, n in ((RX.q_stream_score, 200), (RX.q_stream_confusion, None)):
        a, b = (sorted(map(tuple, query(spark, str(tmp_path / k)).collect())) for k in ("file", "folder"))
        assert a == b and (len(a) == n if n else sum(r[2] for r in a) == 200)
