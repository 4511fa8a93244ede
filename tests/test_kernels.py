import os
import random
import zlib

import pytest

from arkline.functions import kernels as k
from arkline.functions import sizes
from arkline.functions.unicode import fold_text


def test_known_sums():
    assert k.crc64(b"123456789") == 0x995DC9BBDF1939FA
    assert k.blake2sp(bytes(range(16))).hex().startswith("b9194519")
    a, b = os.urandom(1000), os.urandom(777)
    assert k.crc32_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert k.crc64(b, k.crc64(a)) == k.crc64(a + b)


def test_parity_recovers_any_losses():
    shards = [os.urandom(64) for _ in range(6)]
    parities = k.parity(shards, 3)
    for lost in ([0], [1, 4], [2, 3, 5]):
        assert k.recover([None if i in lost else s for i, s in enumerate(shards)], parities) == shards
    with pytest.raises(ValueError):
        k.recover([None] * 4 + shards[4:], parities)


def test_filters_round_trip():
    data = os.urandom(1001)
    assert all(k.delta_decode(k.delta_encode(data, c), c) == data for c in (1, 3, 4, 32))
    code = bytes(random.choice([0xE8, 0xE9, 0, 1, 255, 7]) for _ in range(5000))
    assert k.calls(k.calls(code, 100, True, True), 100, True) == code
    assert k.branches(k.branches(code, 8, True), 8) == code


@pytest.mark.parametrize("value", [0, 1, 127, 128, 1 << 40, (1 << 64) - 1])
def test_vint(value):
    assert k.read_vint(k.vint(value), 0) == (value, len(k.vint(value)))


def _slow_chunks(data):
    gear, mask, out, h, size, end = [int(g) for g in k.gear_table()], (1 << 64) - 1, [], 0, 0, 0
    for b in data:
        h, size, end = (h << 1) + gear[b] & mask, size + 1, end + 1
        if size >= k.MIN_CHUNK and h >> (47 if size < k.AVG_CHUNK else 49) == 0 or size == k.MAX_CHUNK:
            out.append((end - size, size, h))
            h = size = 0
    return out + ([(end - size, size, h)] if size else [])


def test_chunks_equal_the_byte_loop_in_any_pieces():
    data = random.Random(1).randbytes(400_000) + bytes(300_000)
    want, c, got = _slow_chunks(data), k.Chunker(), []
    assert k.chunks(data) == want
    for at in range(0, len(data), 70_001):
        got += c.feed(data[at : at + 70_001])
    assert got + list(c.finish()) == want


def test_keys_and_limits():
    aes, hashed, check = k.derive_keys("secret", b"s" * 16, 4)
    assert len(aes) == len(hashed) == 32 and len(check) == 8
    with pytest.raises(ValueError):
        k.derive_keys("secret", b"s" * 16, 30)
    assert k.inflate(zlib.compress(b"abc" * 10)[2:-4], 30) == b"abc" * 10
    with pytest.raises(ValueError):
        k.inflate(zlib.compress(b"abc" * 10)[2:-4], 29)


def test_volume_sizes_and_folding():
    assert [sizes.volume_size(x) for x in ("", "-", "100k", "1.5g", "7", "x", "5q")] == [sizes.AUTO, 0, 102400, 1610612736, 7, None, None]
    assert fold_text("Straße ẞ İ ΣΑΣ") == "straße ß İ σασ"


def test_parity_and_repair_of_frames(spark):
    from pyspark.sql import functions as F

    from arkline.operators import recovery

    df = spark.createDataFrame([(1, bytearray(range(256)) * 20), (2, bytearray(b"x")), (3, bytearray(b""))], "id long, content binary")
    safe = recovery.protect(df, 30)
    width = F.col("group_count").cast("int")
    broken = safe.withColumn("bad", F.when(F.octet_length("content") > width, F.concat(F.unhex(F.expr("repeat('00', cast(group_count as int))")), F.substring("content", width + 1, F.octet_length("content")))).otherwise(F.col("content")))
    fixed = broken.select("id", "content", recovery.repaired("bad", F.array(F.lit(0)), "parity", "d").alias("again"))
    assert all(bytes(r.content) == bytes(r.again) for r in fixed.collect() if r.id != 3)


def test_unpadded_decryption(spark):
    from pyspark.sql import functions as F

    from arkline.functions import crypto

    key, iv, text = b"k" * 32, b"i" * 16, b"sixteen byte msg" * 2
    sealed = spark.range(1).select(F.aes_encrypt(F.lit(text), F.lit(key), F.lit("CBC"), F.lit("PKCS"), F.lit(iv)).alias("c"))
    bare = sealed.select(F.substring("c", 17, 32).alias("c"))  # no IV, no padding block
    assert bytes(bare.select(crypto.decrypt_cbc(F.col("c"), F.lit(key), F.lit(iv)).alias("p")).first().p) == text
    keys = spark.createDataFrame([("pw", bytearray(b"s" * 16), 3)] * 2, "p string, s binary, n int").select(crypto.keys_column("p", "s", "n").alias("k"))
    assert {bytes(r.k.aes_key) for r in keys.collect()} == {k.derive_keys("pw", b"s" * 16, 3)[0]}


def test_transcoding_plan(spark):
    from arkline.operators import transcode

    rows = [("z", 0, "d/", True, None, None, None), ("z", 1, "a", False, bytearray(b"same"), None, None), ("z", 2, "b", False, bytearray(b"same"), None, None), ("z", 3, "l", False, None, (4, False, "a"), None), ("z", 4, "m", False, None, (4, False, "later"), None), ("z", 5, "e", False, bytearray(b""), None, None), ("z", 6, "bad", False, None, None, "crc32")]
    df = spark.createDataFrame(rows, "archive string, entry_idx long, name string, is_dir boolean, content binary, redir struct<type: int, dir_target: boolean, target: string>, error string")
    assert [r.becomes for r in transcode.plan(df).orderBy("entry_idx").collect()] == ["dir", "file", "reference", "link", "skip", "file", "skip"]
