"""Archives written and read back, and the registered queries of archives against their SQL."""

import gzip
import io
import random
import tarfile

import duckdb
import pytest
from pyspark.sql import functions as F

from arkline.functions import kernels
from arkline.operators import catalog
from arkline.plans import archive_queries, catalog_queries
from arkline.sources import archives, foreign, rar5

NAMES = [n for n, f in catalog_queries.QUERIES.items() if f.__module__ == archive_queries.__name__]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _files(n=20, seed=1):
    rng = random.Random(seed)
    return [{"name": f"f{i}.txt", "content": rng.randbytes(rng.randrange(900)), "mtime": i} for i in range(n)] + [{"name": "d", "is_dir": True}, {"name": "c", "redir": (5, "f1.txt")}]


def _scan(data, name="x"):
    return rar5.scan(io.BytesIO(data), len(data), name)


def _quick(data):
    return rar5.quick_open(io.BytesIO(data), len(data), "x")


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql(spark, data, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = catalog_queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    want = con.execute(catalog_queries.ORACLE_SQL[name])
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert len(order) == len(want.description)
    assert got == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("rows", [40, 0])
def test_extracted_files_of_empty_texts_equal_their_sql(spark, tmp_path, rows):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS doc_id, CASE i // 4 % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'text ' || i END AS text, 'web' AS source FROM range({rows}) t(i)) TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    got = catalog_queries.QUERIES["extracted_files"](spark, str(tmp_path)).select("target", "status", "sha256").collect()
    want = con.execute(catalog_queries.ORACLE_SQL["extracted_files"]).fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(r["sha256"] is not None for r in got) == rows * 3 // 4


def test_a_folder_scan_leaves_no_file_out(spark, tmp_path):
    made = {"a.txt": b"1", "empty.txt": b"", ".hidden": b"22", "_under": b"333", ".git/x.txt": b"", "_d/e/f g%20h.md": b"4444", "é/{b}.txt": b"5" * 3000}
    for name, content in made.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    (tmp_path / "in" / f".arkline-{'0' * 32}").write_bytes(b"not whole")  # what a failed task left
    folder = f"file://{tmp_path}/in"
    rows = archives.scan_files(spark, folder).collect()
    assert {r["name"]: r["content"] for r in rows} == made and len(rows) == len(made)
    assert all(r["unp_size"] == len(r["content"]) and r["mtime_unix"] == int((tmp_path / "in" / r["name"]).stat().st_mtime) for r in rows)
    assert {r["name"] for r in archives.scan_files(spark, folder + "/", "[a-e]*.{txt,md}").collect()} == {"a.txt", "empty.txt"}
    assert [r["name"] for r in archives.scan_files(spark, folder + "/_under").collect()] == ["_under"]


def test_a_folder_scan_is_cut_by_files_and_bytes(tmp_path, monkeypatch):
    for k in range(10):
        (tmp_path / f"{k}").write_bytes(b"x" * (k * 10))
    monkeypatch.setattr(archives, "_PART_FILES", 4)
    monkeypatch.setattr(archives, "_PART_BYTES", 100)
    monkeypatch.setattr(archives, "_BATCH_BYTES", 50)
    reader = archives._FolderReader({"path": f"file://{tmp_path}"})
    parts = reader.partitions()
    assert all(len(p.found) <= 4 for p in parts) and len(parts) > 3
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((r["name"], r["unp_size"], len(r["content"])) for r in rows) == [(f"{k}", k * 10, k * 10) for k in range(10)]


def test_an_index_gives_the_entries_of_a_scan():
    data = rar5.pack(_files(), comment="hi é", index=True)
    assert _quick(data).entries == [e for e in _scan(data).entries if e["service_type"] != "QO"]
    assert _quick(rar5.pack(_files())) is None


def test_an_unsound_index_is_left_for_a_scan():
    data = rar5.pack(_files(), index=True)
    index = next(e for e in _scan(data).entries if e["service_type"] == "QO")
    for at in range(index["data_offset"], index["data_offset"] + index["data_size"], 37):
        assert _quick(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :]) is None
    # a header that the index doesn't know leaves a gap
    first = _scan(data).entries[3]["header_offset"]
    extra = rar5.file_header("hidden", b"xyz") + b"xyz"
    assert _quick(data[:first] + extra + data[first:]) is None


@pytest.mark.parametrize("size", [220, 1000, 1 << 20])
@pytest.mark.parametrize("digest", [False, True])
def test_volumes_join_again(size, digest):
    files = _files()
    volumes = rar5.pack_volumes(files, size, digest)
    assert all(len(v) <= size for v in volumes)
    entries = rar5.joined([_scan(v, str(k)).entries for k, v in enumerate(volumes)])
    assert [e["name"] for e in entries] == [f["name"] for f in files]
    for e, f in zip(entries, files, strict=True):
        content = b"".join(volumes[int(p)][o : o + n] for p, o, n in e["extents"])
        assert content == f.get("content", b"") and rar5.verdict(e, content) in (True, None)
    with pytest.raises(ValueError, match="too few"):
        rar5.pack_volumes(files, 60)


def test_replay_keeps_the_rest_byte_by_byte():
    data = rar5.pack(_files(), comment="c", index=True)
    entries = _scan(data).entries
    drop = frozenset(e["header_offset"] for e in entries if e["name"] in ("f3.txt", "f5.txt"))
    after = rar5.replayed(data, drop, [{"name": "new", "content": b"n"}])
    kept = [e["name"] for e in entries if e["name"] not in ("f3.txt", "f5.txt", "QO")]
    assert [e["name"] for e in _quick(after).entries] == [*kept, "new"]
    locked = rar5.replayed(data, frozenset(), [], lock=True)
    with pytest.raises(rar5.ArchiveError, match="locked"):
        rar5.replayed(locked, drop, [])
    with pytest.raises(rar5.ArchiveError, match="volume"):
        rar5.replayed(rar5.pack_volumes(_files(), 500)[0], drop, [])


def test_signature_bytes_in_a_stub():
    data = rar5.pack(_files(2))
    stub = b"MZ" + rar5.SIGNATURE + b"no archive here" * 9
    assert _scan(stub + data).entries[0]["header_offset"] > len(stub)


def test_names_stay_in_the_folder(spark, tmp_path):
    df = spark.createDataFrame([("../esc.txt", b"a"), ("/abs/x", b"b"), ("C:\\w\\y", b"c")], "name string, content binary")
    assert archives.write_files(df, f"file://{tmp_path}/out") == 3
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file()) == ["out/abs/x", "out/esc.txt", "out/w/y"]
    for bad in ([("..", b"")], [("a/../b", b""), ("/a/b/../../b", b"")], [(None, b"")]):
        with pytest.raises(ValueError, match="would be written"):
            archives.write_files(spark.createDataFrame(bad, "name string, content binary"), f"file://{tmp_path}/out")


def test_upsert_numbers_follow_the_base(spark):
    base = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 0, 3)], "archive string, entry_idx long, name int")
    batch = spark.createDataFrame([("a", 5, 2), ("a", 6, 9), ("c", 4, 1)], "archive string, entry_idx long, name int")
    got = sorted(tuple(r) for r in catalog.upsert(base, batch, by=["archive"]).select("archive", "entry_idx", "name").collect())
    assert got == [("a", 0, 1), ("a", 2, 2), ("a", 3, 9), ("b", 0, 3), ("c", 0, 1)]


def test_displayed_names_have_no_controls(spark):
    raw = ["a\x1b[1;31mb\x1b[0m", "x\x00y\tz", "é" * 5, "\x1b", None]
    df = spark.createDataFrame([(r,) for r in raw], "n string")
    assert [r[0] for r in df.select(catalog.displayed(F.col("n"), 4)).collect()] == ["ab", "xyz", "ééé…", "", None]


def test_encrypted_payloads_open_with_their_password(spark, tmp_path):
    import hashlib
    import zlib

    salt, iv, lg2 = bytes(range(16)), bytes(range(16, 32)), 5
    aes, hash_key, check = kernels.derive_keys("secret é", salt, lg2)
    plain = [b"", b"x" * 16, b"some text of thirty-nine bytes or thereabouts"]
    parts = [rar5.SIGNATURE, rar5._block(rar5.MAIN, 0, kernels.vint(0))]
    for k, text in enumerate(plain):
        padded = text + bytes(-len(text) % 16)
        row = spark.createDataFrame([(padded, aes, iv)], "c binary, k binary, iv binary")
        # CBC by blocks: each is the encryption of the text xor the block before
        out, last = b"", iv
        for at in range(0, len(padded), 16):
            block = bytes(a ^ b for a, b in zip(padded[at : at + 16], last, strict=True))
            last = bytes(row.select(F.substring(F.aes_encrypt(F.lit(block), F.col("k"), F.lit("ECB"), F.lit("PKCS")), 1, 16)).first()[0])
            out += last
        mac, folded = kernels.hmac_sha256(hash_key, zlib.crc32(text).to_bytes(4, "little")), 0
        for i in range(0, 32, 4):
            folded ^= int.from_bytes(mac[i : i + 4], "little")
        parts += [rar5.file_header(f"f{k}", out, crypt=(len(text), folded, lg2, salt, iv, check + hashlib.sha256(check).digest()[:4])), out]
    parts += [rar5.file_header("open", b"open"), b"open", rar5._block(rar5.END, 0, kernels.vint(0))]
    (tmp_path / "a.rar").write_bytes(b"".join(parts))
    entries = archives.read_archives(spark, f"file://{tmp_path}/a.rar", content=True, encrypted="raw")
    got = {r["name"]: (bytes(r["content"]), r.ok, r.locked) for r in archives.decrypted(entries, "secret é").collect()}
    assert got == {"f0": (b"", True, False), "f1": (plain[1], True, False), "f2": (plain[2], True, False), "open": (b"open", True, False)}
    wrong = {r["name"]: (r["content"], r.ok, r.locked) for r in archives.decrypted(entries, "other").collect()}
    assert wrong["f2"] == (None, None, True) and wrong["open"][1:] == (True, False)
    closed = archives.read_archives(spark, f"file://{tmp_path}/a.rar", content=True).where("name = 'f2'").first()
    assert closed["content"] is None and closed.ok is None


def test_global_pax_records_hold_for_all_members():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT, pax_headers={"mtime": "7.5"}) as t:
        for name in ("a", "b"):
            info = tarfile.TarInfo(name)
            info.size = 1
            t.addfile(info, io.BytesIO(b"x"))
    raw = out.getvalue()
    assert [(e["name"], e["utime_unix"], e["mtime_ns"]) for e in foreign.read_tar(io.BytesIO(raw), len(raw), "x")] == [("a", 7, 500_000_000), ("b", 7, 500_000_000)]


def test_gzip_passes_in_pieces():
    texts = [b"", b"one", random.Random(2).randbytes(300_000), b"z" * 2_000_000]
    raw = b"".join(gzip.compress(t, mtime=9) for t in texts)
    entry, content = foreign.read_gzip(io.BytesIO(raw + bytes(100)), "d/x.txt.gz")
    assert content == b"".join(texts) and (entry["name"], entry["unp_size"], entry["utime_unix"], entry["pack_size"]) == ("x.txt", len(content), 9, len(raw) + 100)
    again, nothing = foreign.read_gzip(io.BytesIO(raw), "d/x.txt.gz", keep=False)
    assert nothing is None and again["crc32"] == entry["crc32"]
    for bad in (raw[:-3], raw + b"tail", raw[:1000] + bytes([raw[1000] ^ 1]) + raw[1001:]):
        with pytest.raises(rar5.ArchiveError):
            foreign.read_gzip(io.BytesIO(bad), "x.gz")
    with pytest.raises(rar5.ArchiveError, match="cap"):
        foreign.read_gzip(io.BytesIO(raw), "x.gz", cap=1_000_000)
