import gzip
import random

import pandas as pd

from arkline.functions import kernels
from arkline.streaming import feed


def test_catalog_feed_equals_one_batch(spark, tmp_path):
    schema = "entry_idx long, name string, unp_size long"
    batches = [[(0, "a", 1), (1, "b", 1)], [(2, "a", 2), (3, "c", 1), (4, "c", 5)], [(5, "b", 9)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/in/*")
    query = feed.keep_catalog(stream, f"{tmp_path}/catalog", f"{tmp_path}/state")
    query.processAllAvailable()
    query.stop()
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/catalog/v2").select("name", "entry_idx", "unp_size").collect()}
    assert got == {("a", 2, 2), ("b", 5, 9), ("c", 4, 5)}


def test_streamed_chunks_equal_whole_files(spark, tmp_path):
    rng = random.Random(6)
    files = {"x": rng.randbytes(300_000), "y": rng.randbytes(90_000), "z": b""}
    rows = []
    for name, data in files.items():
        cuts = [data[i : i + 50_000] for i in range(0, len(data), 50_000)] or [b""]
        rows += [(name, i, c, i == len(cuts) - 1) for i, c in enumerate(cuts)]
    rng.shuffle(rows)
    for i in range(3):
        frame = pd.DataFrame(rows[i::3], columns=["file", "seq", "content", "last"])
        spark.createDataFrame(frame, "file string, seq long, content binary, last boolean").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("file string, seq long, content binary, last boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = feed.chunk_files(stream).writeStream.format("memory").queryName("chunks").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {name: sorted((r.offset, r.length, r.hash & (1 << 64) - 1) for r in spark.table("chunks").where(f"file = '{name}'").collect()) for name in files}
    assert got == {name: kernels.chunks(data) for name, data in files.items()}


def test_streamed_codec_round_trip(spark, tmp_path):
    rng = random.Random(7)
    files = {"x": rng.randbytes(50_000) + b"ab" * 60_000, "y": b"", "z": b"hello " * 30_000}
    rows = []
    for name, data in files.items():
        cuts = [data[i : i + 40_000] for i in range(0, len(data), 40_000)] or [b""]
        rows += [(name, i, c, i == len(cuts) - 1) for i, c in enumerate(cuts)]
    rng.shuffle(rows)
    schema = "file string, seq long, content binary, last boolean"

    def run(frames, work, label):
        for i, part in enumerate(frames):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{label}/{i}")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{label}/*")
        query = work(stream).writeStream.format("memory").queryName(label).outputMode("append").start()
        query.processAllAvailable()
        query.stop()
        return [tuple(r) for r in spark.table(label).collect()]

    packed = run([rows[i::3] for i in range(3)], feed.encode_files, "packed")
    whole = {n: b"".join(bytes(c) for _, _, c, _ in sorted(r for r in packed if r[0] == n)) for n in files}
    assert {n: gzip.decompress(x) for n, x in whole.items()} == files
    assert len(whole["z"]) < 2_000
    rng.shuffle(packed)
    back = run([packed[i::2] for i in range(2)], feed.decode_files, "unpacked")
    assert {n: b"".join(bytes(c) for _, _, c, _ in sorted(r for r in back if r[0] == n)) for n in files} == files
