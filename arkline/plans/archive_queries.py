"""Queries that write archives of the documents table and read them back, and views of entries, each with its SQL for DuckDB."""

from __future__ import annotations

import io
import tarfile
import zipfile
import zlib

import pandas as pd
from pyspark.sql import functions as F

from ..functions import crypto, kernels, paths, sizes
from ..operators import catalog, dedup, leaderboard, planner, recovery
from ..sources import archives, folders
from .catalog_queries import _read, query

_FILES = 40  # to an archive


def _files(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("long")
    return docs.select(F.call_function("div", number, F.lit(_FILES).cast("long")).alias("archive"), number.alias("entry_idx"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"), number.alias("mtime_unix"))


def _written(spark, built, label, suffix="rar"):
    """The folder that holds each row's archive as a file."""
    folder = folders.scratch(spark, label)
    named = built.select(F.concat(F.col("archive").cast("string"), F.lit(f".{suffix}")).alias("name"), "content") if "archive" in built.columns else built
    archives.write_files(named, folder)
    return folder


def _archive():
    """The archive's number, from its file's name."""
    return F.regexp_extract("archive", r"([0-9]+)(\.part[0-9]+)?\.[a-z]+$", 1).cast("long").alias("archive")


def _read_back(entries):
    return entries.where("NOT is_service").select(_archive(), "name", F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("sha256"), F.coalesce("ok", F.lit(True)).alias("ok"))


_CONTENTS = f"SELECT doc_id // {_FILES} AS archive, source || '/' || doc_id AS name, octet_length(encode(coalesce(text, '')))::BIGINT AS size, sha256(coalesce(text, '')) AS sha256, true AS ok FROM documents"


@query(_CONTENTS)
def rar_read_back(spark, sf_dir):
    folder = _written(spark, archives.packed(_files(spark, sf_dir)), "rar")
    return _read_back(archives.read_archives(spark, folder, content=True))


@query(f"SELECT archive, entry_idx, name, unp_size, pack_size, method, is_dir, utime_unix, host_os, data_size FROM (SELECT doc_id // {_FILES} AS archive, row_number() OVER (PARTITION BY doc_id // {_FILES} ORDER BY doc_id) AS entry_idx, source || '/' || doc_id AS name, octet_length(encode(coalesce(text, '')))::BIGINT AS unp_size, octet_length(encode(coalesce(text, '')))::BIGINT AS pack_size, 0 AS method, false AS is_dir, doc_id::BIGINT AS utime_unix, 1 AS host_os, octet_length(encode(coalesce(text, '')))::BIGINT AS data_size FROM documents)")
def rar_index_scan(spark, sf_dir):
    """Entries from the archives' own index; the comment before the files is entry 0."""
    folder = _written(spark, archives.packed(_files(spark, sf_dir), comment="a comment", index=True), "index")
    entries = archives.read_archives(spark, folder, quickOpen=True).where("NOT is_service")
    return entries.select(_archive(), "entry_idx", "name", "unp_size", "pack_size", "method", "is_dir", "utime_unix", "host_os", "data_size")


@query(f"SELECT DISTINCT doc_id // {_FILES} AS archive, 'Größe of it' AS comment FROM documents")
def rar_comments(spark, sf_dir):
    folder = _written(spark, archives.packed(_files(spark, sf_dir), comment="Größe of it"), "comment")
    return archives.comments(archives.read_archives(spark, folder, content=True)).select(_archive(), "comment")


@query(f"SELECT doc_id // {_FILES} AS archive, count(*) AS file_count, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS total_unpacked_bytes, true AS has_comment, 9::BIGINT AS comment_size, true AS has_index, false AS has_recovery FROM documents GROUP BY ALL")
def service_presence(spark, sf_dir):
    folder = _written(spark, archives.packed(_files(spark, sf_dir), comment="a comment", index=True), "services")
    tallies = catalog.inspect(archives.read_archives(spark, folder), ["archive"])
    return tallies.select(_archive(), "file_count", "total_unpacked_bytes", "has_comment", "comment_size", (F.col("qo_offset").isNotNull() & (F.col("qo_size") > 0)).alias("has_index"), "has_recovery")


@query(_CONTENTS)
def volume_read_back(spark, sf_dir):
    folder = _written(spark, archives.packed_volumes(_files(spark, sf_dir), 16_000), "volumes")
    return _read_back(archives.read_archives(spark, folder, content=True))


def _grouped(files, build):
    """archive and content: what build makes of an archive's (name, content, mtime) rows."""
    def one(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("entry_idx")
        data = build(list(zip(rows["name"], rows["content"], rows["mtime_unix"], strict=True)))
        return pd.DataFrame({"archive": [group["archive"].iloc[0]], "content": [data]})

    return files.groupBy("archive").applyInPandas(one, "archive long, content binary")


def _zipped(rows):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, (name, content, _) in enumerate(rows):
            z.writestr(zipfile.ZipInfo(name), content, zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
    return out.getvalue()


def _tarred(rows):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as t:
        for name, content, mtime in rows:
            info = tarfile.TarInfo(name)
            info.size, info.mtime = len(content), mtime
            t.addfile(info, io.BytesIO(content))
    return out.getvalue()


@query(_CONTENTS)
def zip_read_back(spark, sf_dir):
    folder = _written(spark, _grouped(_files(spark, sf_dir), _zipped), "zip", "zip")
    return _read_back(archives.read_archives(spark, folder, content=True))


@query(f"SELECT c.archive, c.name, c.size, c.sha256, c.ok, d.doc_id::BIGINT AS utime_unix FROM ({_CONTENTS}) c JOIN documents d ON c.name = d.source || '/' || d.doc_id")
def tar_read_back(spark, sf_dir):
    folder = _written(spark, _grouped(_files(spark, sf_dir), _tarred), "tar", "tar")
    entries = archives.read_archives(spark, folder, content=True)
    return _read_back(entries).join(entries.select("name", "utime_unix"), "name").select("archive", "name", "size", "sha256", "ok", "utime_unix")


@query(f"SELECT doc_id // {_FILES} AS archive, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS size, sha256(string_agg(coalesce(text, ''), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY ALL")
def gzip_read_back(spark, sf_dir):
    """Each document a member of its archive's one gzip file."""
    members = lambda rows: b"".join(zlib.compress(c, wbits=31) for _, c, _ in rows)
    folder = _written(spark, _grouped(_files(spark, sf_dir), members), "gzip", "gz")
    return _read_back(archives.read_archives(spark, folder, content=True)).select("archive", "size", "sha256")


@query(
    f"""
WITH c AS (SELECT doc_id, doc_id // {_FILES} AS archive, source || '/' || doc_id AS name, coalesce(text, '') AS t FROM documents)
SELECT archive, name, sha256(CASE WHEN doc_id % 5 = 2 THEN 'new ' || t ELSE t END) AS sha256, doc_id % 5 = 2 AS added FROM c WHERE doc_id % 5 <> 1
"""
)
def archive_replay(spark, sf_dir):
    """A fifth of the files deleted, a fifth replaced, the rest kept byte by byte; replaced files come last."""
    files = _files(spark, sf_dir)
    first = archives.packed(files, comment="kept", index=True)
    entries = archives.read_archives(spark, _written(spark, first, "replay"))
    gone = entries.where("NOT is_service").withColumn("n", F.regexp_extract("name", r"/([0-9]+)$", 1).cast("long")).where("n % 5 IN (1, 2)").select(_archive(), "header_offset")
    batch = files.where("entry_idx % 5 = 2").withColumn("content", F.concat(F.lit("new ").cast("binary"), "content"))
    folder = _written(spark, archives.replayed(first, gone, batch), "replayed")
    back = archives.read_archives(spark, folder, content=True, quickOpen=True)
    last = back.where("NOT is_service").withColumn("n", F.regexp_extract("name", r"/([0-9]+)$", 1).cast("long"))
    kept = last.where("n % 5 <> 2").groupBy(F.col("archive").alias("_a")).agg(F.max("entry_idx").alias("_last"))
    return last.join(kept, F.col("archive") == F.col("_a"), "left").select(_archive(), "name", F.sha2("content", 256).alias("sha256"), (F.col("entry_idx") > F.coalesce("_last", F.lit(-1))).alias("added"))


_REPORT = """
WITH e AS (SELECT doc_id // 40 AS archive, doc_id AS entry_idx, octet_length(encode(coalesce(text, ''))) AS n, CASE doc_id % 4 WHEN 0 THEN '../' || doc_id WHEN 1 THEN '/abs/' || doc_id WHEN 2 THEN 'a/./b/' || doc_id ELSE 'SHORT~1/' || doc_id END AS name,
  CASE doc_id % 4 WHEN 0 THEN doc_id::VARCHAR WHEN 1 THEN 'abs/' || doc_id WHEN 2 THEN 'a/b/' || doc_id ELSE 'SHORT~1/' || doc_id END AS target FROM documents),
s AS (SELECT *, sum(n) OVER (PARTITION BY archive ORDER BY entry_idx) AS total FROM e),
b AS (SELECT *, CASE WHEN n > 20000 THEN 'member' WHEN total > 60000 THEN 'total' END AS breach FROM s),
a AS (SELECT *, bool_or(breach IS NOT NULL) OVER (PARTITION BY archive ORDER BY entry_idx) AS aborted FROM b)
SELECT archive, entry_idx, target, CASE WHEN aborted THEN 'aborted' WHEN entry_idx % 4 = 3 THEN 'skipped' ELSE 'extracted' END AS status,
  CASE WHEN aborted THEN coalesce(breach, 'after a breach') WHEN entry_idx % 4 = 3 THEN 'short alias' END AS reason, CASE entry_idx % 4 WHEN 0 THEN 'traversal,renamed' WHEN 1 THEN 'absolute_path,renamed' WHEN 2 THEN 'renamed' ELSE '' END AS flags FROM a
"""


def _risky(spark, sf_dir):
    number = F.col("entry_idx").cast("string")
    k = F.col("entry_idx") % 4
    name = F.when(k == 0, F.concat(F.lit("../"), number)).when(k == 1, F.concat(F.lit("/abs/"), number)).when(k == 2, F.concat(F.lit("a/./b/"), number)).otherwise(F.concat(F.lit("SHORT~1/"), number))
    return _files(spark, sf_dir).withColumn("name", name).select("*", F.lit(False).alias("is_service"), F.lit(False).alias("is_dir"), F.lit(True).alias("ok"), F.lit(0).cast("long").alias("attributes"), F.octet_length("content").cast("long").alias("unp_size"), F.expr("cast(null as struct<type: int, dir_target: boolean, target: string>)").alias("redir"))


@query(_REPORT)
def extraction_report(spark, sf_dir):
    report = archives.extraction_report(_risky(spark, sf_dir), 20_000, 60_000)
    return report.select("archive", "entry_idx", "target", "status", "reason", F.array_join("security_flags", ",").alias("flags"))


@query(f"SELECT target, status, CASE WHEN status = 'extracted' THEN sha256(coalesce(text, '')) END AS sha256 FROM ({_REPORT}) JOIN documents ON doc_id = entry_idx")
def extracted_files(spark, sf_dir):
    """What extraction wrote, read from the folder again."""
    folder = folders.scratch(spark, "extract")
    report = archives.extract(_risky(spark, sf_dir), folder, 20_000, 60_000)
    found = archives.scan_files(spark, folder).select(F.col("name").alias("_found"), F.sha2("content", 256).alias("sha256"))
    return report.join(found, F.col("target") == F.col("_found"), "left").select("target", "status", "sha256")


#: Known answers (fixed values): algorithm, input in hexadecimal, result in hexadecimal.
VECTORS = (
    ("blake2sp", "000102030405060708090a0b0c0d0e0f", "b9194519e4978a9dc893b28bd808cdfabb1bd510d862b3171ff6e017a41b804c"),
    ("blake2sp", bytes(range(128)).hex(), "05cf3a90049116dc60efc31536aaa3d167762994892876dcb7ef3fbecd7449c0"),
    ("crc32", b"123456789".hex(), "cbf43926"),
    ("crc64", b"123456789".hex(), "995dc9bbdf1939fa"),
    ("sha256", b"abc".hex(), "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"),
    ("hmac", b"what do ya want for nothing?".hex(), "5bdcc146bf60754e6a042426089575c75a003f089d2739839dec58b964ec3843"),
    ("pbkdf2", b"salt".hex(), "120fb6cffcf8b32c43e7225256c4f837a86548c92ccc35480805987cb70be17b"),
)
_VALUES = ", ".join(f"('{a}', '{x}', '{y}')" for a, x, y in VECTORS)


@query(f"SELECT * FROM (VALUES {_VALUES}) t(algorithm, input, result)")
def digest_vectors(spark, sf_dir):
    rows = spark.createDataFrame([v[:2] for v in VECTORS], "algorithm string, input string").withColumn("raw", F.unhex("input"))
    mac = F.udf(lambda raw: kernels.hmac_sha256(b"Jefe", bytes(raw)).hex())
    made = (
        F.when(F.col("algorithm") == "blake2sp", F.lower(F.hex(kernels.blake2sp_column("raw"))))
        .when(F.col("algorithm") == "crc64", F.lower(F.hex(kernels.crc64_column("raw"))))
        .when(F.col("algorithm") == "crc32", F.lower(catalog.crc_text(F.crc32("raw"))))
        .when(F.col("algorithm") == "hmac", mac("raw"))
        .when(F.col("algorithm") == "pbkdf2", F.lower(F.hex(crypto.keys_column(F.lit("password"), F.col("raw"), F.lit(0))["aes_key"])))
        .otherwise(F.sha2("raw", 256))
    )
    return rows.select("algorithm", "input", made.alias("result"))


@query("SELECT doc_id AS entry_idx, true AS repaired FROM documents WHERE text IS NOT NULL AND text <> ''")
def parity_repair(spark, sf_dir):
    """Every content has as many shards damaged as it has parity, and comes back whole."""
    files = _files(spark, sf_dir).where("octet_length(content) > 0")
    safe = recovery.protect(files, 20)
    lost = F.sequence(F.lit(0), (F.least("nr", "d") - 1).cast("int"))
    lost = F.when(F.least("nr", "d") > 0, lost).otherwise(F.array().cast("array<int>"))
    back = recovery.repaired(F.col("content"), lost, F.col("parity"), F.col("d").cast("int"))
    return safe.select("entry_idx", (back == F.col("content")).alias("repaired"))


# ---------------------------------------------------------------- views


def _entries(spark, sf_dir):
    """Orders as entries with all columns that views read."""
    orders = _read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return orders.select(
        k.alias("entry_idx"), F.concat_ws("/", "o_orderpriority", k.cast("string")).alias("name"), (k % 50 == 0).alias("is_service"), F.lit(None).cast("string").alias("service_type"), (k % 9 == 0).alias("is_dir"), (k * 3).alias("unp_size"),
        F.when(k % 4 != 0, k * 2).alias("pack_size"), (k % 6).cast("int").alias("method"), F.when(k % 7 != 0, k * 2654435761 % 4294967296).alias("crc32"), (k % 3 == 0).alias("is_solid"), F.when(k % 3 == 0, F.lit(4 << 20)).when(k % 3 == 1, F.lit(96 << 10)).otherwise(F.lit(1000)).cast("long").alias("win_size"),
        F.when(k % 5 == 0, k % 8).alias("file_version"), F.when(k % 11 == 0, F.struct(F.lit(1).alias("version"))).alias("crypt"), F.struct(F.lit("u").alias("user"), F.lit("g").alias("group")).alias("owner"), F.col("o_orderdate").cast("timestamp").alias("mtime"),
    )


_SHOWN = """SELECT o_orderkey AS k, o_orderpriority || '/' || o_orderkey AS name, CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey * 2654435761) % 4294967296 END AS crc,
  CASE o_orderkey % 3 WHEN 0 THEN 4194304 WHEN 1 THEN 98304 ELSE 1000 END AS win, o_orderdate FROM orders WHERE o_orderkey % 50 <> 0"""
_CRC = "lpad(upper(to_base(coalesce(crc, 0)::BIGINT, 16)), 8, '0')"


@query(f"SELECT k AS entry_idx, name, k * 3 AS size, CASE WHEN k % 4 <> 0 THEN k * 2 ELSE 0 END AS packed_size, (k % 6)::INT AS method, {_CRC} AS crc32, CASE k % 3 WHEN 0 THEN '4 MB' WHEN 1 THEN '96 KB' ELSE '1000 bytes' END AS dictionary, CASE WHEN k % 5 = 0 THEN k % 8 END AS file_version, 'u' AS owner FROM ({_SHOWN})")
def list_lt(spark, sf_dir):
    return catalog.list_entries(_entries(spark, sf_dir), "lt").withColumn("owner", F.col("owner.user"))


@query(f"""SELECT k AS entry_idx, '{{"name":"' || name || '","unpacked_size":' || k * 3 || ',"packed_size":' || CASE WHEN k % 4 <> 0 THEN k * 2 ELSE 0 END || ',"method":' || k % 6 || ',"crc32":"' || {_CRC} || '","solid":' || (k % 3 = 0) || ',"is_dir":' || (k % 9 = 0) || ',"dictionary_bytes":' || win || '}}' AS json FROM ({_SHOWN})""")
def list_json(spark, sf_dir):
    return catalog.list_entries(_entries(spark, sf_dir), "json")


@query(f"SELECT name AS path, k % 9 = 0 AS is_dir, (k % 6)::INT AS method, k % 11 = 0 AS is_encrypted, coalesce(crc, 0)::BIGINT AS crc32, k * 3 AS size, CASE WHEN k % 4 <> 0 THEN k * 2 ELSE 0 END AS packed_size FROM ({_SHOWN})")
def list_abi(spark, sf_dir):
    return catalog.list_entries(_entries(spark, sf_dir), "abi").select("path", "is_dir", "method", "is_encrypted", "crc32", "size", "packed_size")


@query("SELECT o_orderkey AS entry_idx, (o_orderkey % 4096)::INT & 493 AS plain, (o_orderkey % 4096)::INT & 4077 AS kept FROM orders")
def safe_modes(spark, sf_dir):
    mode = (F.col("o_orderkey") % 4096).cast("int")
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_idx"), catalog.safe_attributes(mode).alias("plain"), catalog.safe_attributes(mode, keep_setid=True).alias("kept"))


@query("SELECT path, kind FROM (SELECT source || '/' || doc_id AS path, doc_id, CASE WHEN doc_id % 11 = 3 AND doc_id % 13 = 5 THEN NULL WHEN doc_id % 11 = 3 THEN 'added' WHEN doc_id % 13 = 5 THEN 'deleted' WHEN doc_id % 7 = 1 THEN 'modified' WHEN doc_id % 5 = 2 AND ascii(lang) <> ascii('x') THEN 'metadata_diff' END AS kind FROM documents) WHERE kind IS NOT NULL ORDER BY path")
def diff_sorted(spark, sf_dir):
    from . import catalog_queries

    return catalog.diff_rows(catalog_queries.diff_catalog(spark, sf_dir))


@query("SELECT page_id AS entry_idx, CASE page_id % 5 WHEN 0 THEN '../x' WHEN 1 THEN '../../x' WHEN 2 THEN '/etc' WHEN 3 THEN 'a/../../../b' ELSE 'a/../b' END AS target, page_id % 5 IN (1, 2, 3) AS escapes FROM pages")
def link_legality(spark, sf_dir):
    k = F.col("page_id") % 5
    target = F.when(k == 0, "../x").when(k == 1, "../../x").when(k == 2, "/etc").when(k == 3, "a/../../../b").otherwise("a/../b")
    return _read(spark, sf_dir, "pages").select(F.col("page_id").alias("entry_idx"), target.alias("target"), paths.link_escapes(F.lit("d/link"), target).alias("escapes"))


@query("SELECT p_partkey AS entry_idx, p_name AS last, 'sub/' || p_name AS based, 'base/sub/' || p_name AS relative, 'C:/base/sub/' || p_name AS whole FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS p_name FROM part)")
def archive_names(spark, sf_dir):
    full = F.concat(F.lit("C:\\base\\sub\\"), F.translate("p_name", " ", "_"))
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry_idx"), paths.archive_name(full, mode="ep").alias("last"), paths.archive_name(full, "C:/base", "ep1").alias("based"), paths.archive_name(full, mode="ep2").alias("relative"), paths.archive_name(full, mode="ep3").alias("whole"))


@query("SELECT c_custkey AS entry_idx, c_custkey % 3 = 0 AS alias, c_custkey % 4 <> 0 AS inside FROM customer")
def alias_and_containment(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.concat(F.when(k % 3 == 0, "DOCUME~1/").otherwise("docs~x/"), "c_name")
    place = F.when(k % 4 == 0, "../..").otherwise(F.concat(F.lit("../../"), "c_name"))
    return _read(spark, sf_dir, "customer").select(k.alias("entry_idx"), paths.short_alias(name).alias("alias"), paths.contained(place, "/root").alias("inside"))


@query("SELECT c_custkey AS entry_idx, 'security.s,trusted.t,user.a' AS stored, 'user.a' AS restored, 'trusted.t,user.a,security.s' AS admin FROM customer")
def xattr_rules(spark, sf_dir):
    names = ("trusted.t", "system.x", "user.a", "security.s", "com.apple.quarantine")
    every = F.array(*[F.struct(F.lit(n).cast("binary").alias("name"), F.lit(b"v").cast("binary").alias("value")) for n in names])
    listed = lambda x: F.array_join(F.transform(x, lambda a: a["name"].cast("string")), ",")
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entry_idx"), listed(catalog.stored_xattrs(every)).alias("stored"), listed(catalog.restored_xattrs(every)).alias("restored"), listed(catalog.restored_xattrs(every, security=True)).alias("admin"))


@query("SELECT c_custkey AS entry_idx, c_name AS plain, CASE WHEN length(c_name) > 12 THEN substr(c_name, 1, 11) || chr(8230) ELSE c_name END AS cut FROM customer")
def displayed_names(spark, sf_dir):
    name = F.concat(F.lit("\x1b[31m"), F.col("c_name"), F.lit("\x07\x1b[0m"))
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entry_idx"), catalog.displayed(name).alias("plain"), catalog.displayed(name, 12).alias("cut"))


@query("SELECT doc_id AS entry_idx, sha256(coalesce(text, '')) AS sha256 FROM documents WHERE ends_with((source || '/' || doc_id), '7')")
def print_masked(spark, sf_dir):
    entries = _files(spark, sf_dir).select("*", F.lit(False).alias("is_service"), F.lit(False).alias("is_dir"))
    return catalog.printed(entries, ["*7"]).select("entry_idx", F.sha2("content", 256).alias("sha256"))


@query("SELECT 'none' AS masks, 0::BIGINT AS files, 10 AS exit_code UNION ALL SELECT 'some', count(*), 0 FROM documents WHERE ends_with((source || '/' || doc_id), '7')")
def print_exit_code(spark, sf_dir):
    entries = _files(spark, sf_dir).select("*", F.lit(False).alias("is_service"), F.lit(False).alias("is_dir"))
    code = lambda label, mask: catalog.print_exit_code(entries, [mask]).select(F.lit(label).alias("masks"), "files", "exit_code")
    return code("none", "*.nothing").unionByName(code("some", "*7"))


def _tens(spark, sf_dir):
    """Parts by tens: archive, and entry_idx from 0 to 9."""
    k = F.col("p_partkey").cast("long") - 1
    return _read(spark, sf_dir, "part").select(F.call_function("div", k, F.lit(10).cast("long")).alias("archive"), (k % 10).alias("entry_idx"), F.col("p_size").cast("long").alias("size"))


@query("SELECT (p_partkey - 1) // 10 AS archive, (p_partkey - 1) % 10 AS entry_idx FROM part WHERE NOT ((p_partkey - 1) // 10 % 3 = 0 AND (p_partkey - 1) % 10 IN (0, 1, 4, 5))")
def delete_by_offset(spark, sf_dir):
    """Every even entry is a file, the odd one behind it its stream; of a third of the archives files 0 and 4 go."""
    odd = F.col("entry_idx") % 2 == 1
    entries = _tens(spark, sf_dir).select("archive", "entry_idx", odd.alias("is_service"), F.when(odd, "STM").alias("service_type"), (F.col("entry_idx") * 100).alias("header_offset"))
    return catalog.delete_at(entries, entries.where("archive % 3 = 0 AND entry_idx IN (0, 4)")).select("archive", "entry_idx")


@query("SELECT archive, entry_idx, (count(*) OVER w)::BIGINT AS header_count, (sum(p_size) OVER w)::BIGINT AS header_bytes, CASE WHEN count(*) OVER w > 7 THEN 'count' WHEN sum(p_size) OVER w > 150 THEN 'bytes' END AS header_breach FROM (SELECT (p_partkey - 1) // 10 AS archive, (p_partkey - 1) % 10 AS entry_idx, p_size FROM part) WINDOW w AS (PARTITION BY archive ORDER BY entry_idx)")
def header_limits(spark, sf_dir):
    headers = _tens(spark, sf_dir).select("archive", "entry_idx", F.lit(0).alias("volume_idx"), F.col("entry_idx").alias("header_offset"), F.col("size").alias("header_size"))
    return catalog.header_limit(headers, 7, 150).select("archive", "entry_idx", "header_count", "header_bytes", "header_breach")


@query("SELECT o_orderkey AS entry_idx, o_orderkey % 10 <> 0 AND o_orderkey % 10 > 4 AS migrates FROM orders WHERE o_orderkey % 10 <> 4")
def hardlink_migration(spark, sf_dir):
    """Of ten orders the fifth is a file; the others link to it by name, the multiples of ten to a name that isn't there."""
    k = F.col("o_orderkey")
    tens = k - k % 10
    name = F.concat(F.lit("f"), k.cast("string"))
    orders = _read(spark, sf_dir, "orders")
    every = orders.select(k.alias("entry_idx")).union(orders.select((tens + 4).alias("entry_idx"))).distinct()
    i = F.col("entry_idx")
    target = F.when(i % 10 == 0, "missing").otherwise(F.concat(F.lit("f"), (i - i % 10 + 4).cast("string")))
    entries = every.select(i, F.concat(F.lit("f"), i.cast("string")).alias("name"), F.when(i % 10 != 4, F.struct(F.lit(4).alias("type"), target.alias("target"))).alias("redir"))
    links = dedup.migratable_links(entries).select("entry_idx", "migrates")
    return links.join(orders.select(k.alias("entry_idx")), "entry_idx", "left_semi")


# ---------------------------------------------------------------- benchmarks and plans


def _records(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    return part.select(F.col("p_brand").alias("brand"), F.col("p_type").alias("system"), F.bround("p_retailprice").cast("long").alias("score"), F.col("p_partkey").alias("input_order"), F.col("p_size").cast("long").alias("size"))


@query("SELECT count(*) AS submissions, max(round_even(p_retailprice, 0)::BIGINT) AS max_score, max(p_size)::BIGINT AS max_size, (SELECT p_brand FROM part ORDER BY round_even(p_retailprice, 0) DESC, p_partkey LIMIT 1) AS top_brand FROM part")
def leaderboard_maxima(spark, sf_dir):
    return leaderboard.maxima(_records(spark, sf_dir), "score", "size")


_COMMUNITY = """
ci AS (SELECT p_partkey AS k, p_brand AS brand, p_type AS system FROM part WHERE p_partkey % 10 = 0 AND p_size < 25),
community AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' rev' ELSE 'Other' || p_partkey END AS brand, p_type AS system FROM part WHERE p_partkey % 10 <> 0)"""


@query(f"WITH {_COMMUNITY} SELECT k AS input_order, 'ci' AS origin FROM ci UNION ALL SELECT k, 'community' FROM community c WHERE NOT EXISTS (SELECT 1 FROM ci WHERE ci.brand = c.brand AND ci.system = c.system OR starts_with(c.brand, ci.brand))")
def leaderboard_union(spark, sf_dir):
    records = _records(spark, sf_dir)
    k = F.col("input_order")
    ci = records.where((k % 10 == 0) & (F.col("size") < 25))
    community = records.where(k % 10 != 0).withColumn("brand", F.when(k % 3 == 0, F.concat("brand", F.lit(" rev"))).otherwise(F.concat(F.lit("Other"), k.cast("string"))))
    return leaderboard.every_record(ci, community).select("input_order", "origin")


@query("SELECT '<tr><td>' || p_partkey || '</td><td>&lt;' || p_brand || ' &amp; co&gt;</td></tr>' AS line FROM part")
def leaderboard_html(spark, sf_dir):
    records = _records(spark, sf_dir).withColumn("brand", F.concat(F.lit("<"), "brand", F.lit(" & co>")))
    return leaderboard.html(records, "input_order", "brand")


@query("SELECT '| ' || p_partkey || ' | ' || p_brand || ' |' AS line FROM part")
def leaderboard_markdown(spark, sf_dir):
    return leaderboard.markdown(_records(spark, sf_dir), "input_order", "brand")


@query("SELECT p_brand AS brand, 'b' || p_partkey AS benchmark, p_size::INT AS threads, p_partkey::INT AS score, true AS verified FROM part WHERE p_partkey % 7 <> 0")
def benchmark_records(spark, sf_dir):
    """Records written as JSON documents, a file each, and read with their schema; some have no results."""
    k = F.col("p_partkey")
    doc = F.struct(F.concat(F.lit("b"), k.cast("string")).alias("benchmark"), F.struct(F.col("p_brand").alias("brand")).alias("cpu"), F.struct(F.col("p_size").alias("threads")).alias("config"), F.when(k % 7 != 0, F.struct(k.cast("int").alias("rarmark_score"), F.lit(True).alias("decompression_verified"))).alias("results"))
    folder = folders.scratch(spark, "records")
    archives.write_files(_read(spark, sf_dir, "part").select(F.concat(k.cast("string"), F.lit(".json")).alias("name"), F.to_json(doc).cast("binary").alias("content")), folder)
    return leaderboard.read_records(spark, folder).select("cpu.brand", "benchmark", "config.threads", F.col("results.rarmark_score").alias("score"), F.col("results.decompression_verified").alias("verified"))


@query("SELECT plan, file_idx, total, NOT bool_or(total > 200) OVER (PARTITION BY plan ORDER BY file_idx) AS fingerprinted FROM (SELECT (p_partkey - 1) // 10 AS plan, (p_partkey - 1) % 10 AS file_idx, (sum(p_size) OVER (PARTITION BY (p_partkey - 1) // 10 ORDER BY p_partkey))::BIGINT AS total FROM part)")
def fingerprint_cap(spark, sf_dir):
    files = _tens(spark, sf_dir).select(F.col("archive").alias("plan"), F.col("entry_idx").alias("file_idx"), F.col("size").alias("chunks"))
    return planner.fingerprinted(files, 200).select("plan", "file_idx", "total", "fingerprinted")


#: Volume sizes as they are written, and what they mean (fixed values).
_SIZES = (("", "auto"), ("-", "0"), ("100b", "100"), ("5k", "5120"), ("1.5m", "1572864"), ("2g", "2147483648"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _SIZES) + ") t(text, bytes)")
def volume_sizes(spark, sf_dir):
    parsed = lambda t: "auto" if sizes.volume_size(t) == sizes.AUTO else str(sizes.volume_size(t))
    return spark.createDataFrame([(t, parsed(t)) for t, _ in _SIZES], "text string, bytes string")


@query("SELECT p_name AS name FROM part")
def listfile_masks(spark, sf_dir):
    """Names as lines of a list file, between comments, blanks and a byte order mark."""
    part = _read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.concat(F.lit("\ufeff; a comment\n# one\n// one\n\n \t"), "p_name", F.lit(" \r\n")).cast("binary").alias("content"))
    folder = folders.scratch(spark, "lists")
    archives.write_files(part, folder)
    return archives.read_listfile(spark, folder)
