"""Catalog queries over the driver's tables, each with its SQL for DuckDB.

The tables stand in for catalogs: documents for files with contents, orders and line items
for entries of archives, conversations for files with child services.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels, masks, paths, sizes, times
from ..operators import catalog, dedup, leaderboard, planner, recovery, solid, volumes

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name, with the SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _documents(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("entry_idx"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"), F.col("n_chars").alias("unp_size"), F.crc32(F.col("text").cast("binary")).alias("crc32"), F.col("text").alias("content"), "source", F.length("lang").cast("int").alias("method"), F.ascii("lang").cast("long").alias("mtime_win"))


_NEW_DOCS = "doc_id % 13 <> 5"


def _sanitised(pages):
    return pages.select(F.col("page_id").alias("entry_idx"), paths.sanitised(F.concat(F.lit("C:/../"), F.regexp_replace("url", "^[^:]*://", ""), F.lit("/"))).alias("path"))


@query(
    """
WITH e AS (SELECT doc_id, source || '/' || doc_id AS path, n_chars, lang FROM documents),
o AS (SELECT * FROM e WHERE doc_id % 11 <> 3),
n AS (SELECT doc_id, path, CASE WHEN doc_id % 7 = 1 THEN n_chars + 1 ELSE n_chars END AS n_chars,
  CASE WHEN doc_id % 5 = 2 THEN 'xx' ELSE lang END AS lang FROM e WHERE doc_id % 13 <> 5)
SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'deleted'
  WHEN o.n_chars <> n.n_chars THEN 'modified' WHEN ascii(o.lang) <> ascii(n.lang) THEN 'metadata_diff' ELSE 'identical' END AS kind
FROM o FULL JOIN n ON o.path = n.path
"""
)
def diff_catalog(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    old = docs.where("entry_idx % 11 <> 3")
    new = docs.where("entry_idx % 13 <> 5").withColumns({"unp_size": F.when(F.col("entry_idx") % 7 == 1, F.col("unp_size") + 1).otherwise(F.col("unp_size")), "mtime_win": F.when(F.col("entry_idx") % 5 == 2, F.lit(ord("x")).cast("long")).otherwise(F.col("mtime_win"))})
    return catalog.diff(old, new).select("path", "kind")


@query(
    """
WITH k AS (SELECT CASE WHEN doc_id % 11 = 3 AND doc_id % 13 = 5 THEN NULL WHEN doc_id % 11 = 3 THEN 'added' WHEN doc_id % 13 = 5 THEN 'deleted'
  WHEN doc_id % 7 = 1 THEN 'modified' WHEN doc_id % 5 = 2 AND ascii(lang) <> ascii('x') THEN 'metadata_diff' ELSE 'identical' END AS kind FROM documents)
SELECT kind, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY kind
"""
)
def diff_summary(spark, sf_dir):
    return catalog.diff_summary(diff_catalog(spark, sf_dir))


@query("SELECT p_partkey AS entry_idx, round_even(p_retailprice, 0)::BIGINT AS size, n AS name FROM (SELECT *, replace(p_type || '/' || p_name, ' ', '_') AS n FROM part) WHERE (regexp_matches(n, '(?s)^.*in.$') OR starts_with(n, 'ECONOMY/')) AND NOT starts_with(p_name, 'red ')")
def list_masked(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    entries = part.select(F.col("p_partkey").alias("entry_idx"), F.translate(F.concat_ws("/", "p_type", "p_name"), " ", "_").alias("name"), F.bround("p_retailprice").cast("long").alias("unp_size"), F.lit(False).alias("is_service"))
    return catalog.list_entries(entries, "l", ["*in?", "ECONOMY/*"], ["red_*"])


@query("SELECT o_orderkey AS entry_idx, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || ';' || (o_orderkey % 7) ELSE o_orderpriority END AS name FROM orders")
def list_bare(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    entries = orders.select(F.col("o_orderkey").alias("entry_idx"), F.col("o_orderpriority").alias("name"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 7).alias("file_version"), F.lit(False).alias("is_service"))
    return catalog.list_entries(entries, "lb")


def _lineitems(spark, sf_dir):
    li = _read(spark, sf_dir, "lineitem")
    kind = F.col("l_linenumber")
    return li.select(
        F.col("l_orderkey").alias("archive"), kind.cast("long").alias("entry_idx"), (kind == 7).alias("is_service"), F.when(kind == 7, "CMT").alias("service_type"), (F.col("l_returnflag") == "A").alias("is_dir"),
        F.struct(F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("type")).alias("redir"), F.when(F.col("l_linestatus") == "F", F.struct(F.lit(1).alias("version"))).alias("crypt"),
        F.col("l_quantity").cast("long").alias("unp_size"), F.floor(F.col("l_quantity") / 2).alias("pack_size"), (F.col("l_partkey") * 1024).alias("win_size"), F.col("l_suppkey").alias("data_size"), F.col("l_partkey").alias("data_offset"),
        (F.col("l_suppkey") % 4).cast("int").alias("method"), (F.col("l_partkey") % 3 != 0).alias("is_solid"), (F.col("l_partkey") % 10 == 0).alias("removed"), F.col("l_partkey").alias("key"),
    )


_TALLY = """
  count(*) FILTER (WHERE l_linenumber <> 7 AND l_returnflag NOT IN ('A', 'R')) AS file_count, count(*) FILTER (WHERE l_linenumber <> 7 AND l_returnflag = 'A') AS dir_count,
  count(*) FILTER (WHERE l_linenumber <> 7 AND l_returnflag = 'R') AS link_count, count(*) FILTER (WHERE l_linenumber <> 7 AND l_linestatus = 'F') AS encrypted_files,
  coalesce(sum(l_quantity::BIGINT) FILTER (WHERE l_linenumber <> 7), 0)::BIGINT AS total_unpacked_bytes, coalesce(sum(floor(l_quantity / 2)::BIGINT) FILTER (WHERE l_linenumber <> 7), 0)::BIGINT AS total_packed_bytes,
  coalesce(max(l_partkey * 1024) FILTER (WHERE l_linenumber <> 7), 0)::BIGINT AS max_dictionary_bytes, coalesce(bool_or(l_linenumber = 7), false) AS has_comment"""


@query(f"SELECT l_orderkey AS archive, {_TALLY} FROM lineitem GROUP BY l_orderkey")
def inspect_by_archive(spark, sf_dir):
    return catalog.inspect(_lineitems(spark, sf_dir), ["archive"]).drop("compression_ratio", "comment_size", "qo_offset", "qo_size", "has_recovery")


@query(f"SELECT {_TALLY}, round(sum(floor(l_quantity / 2)::BIGINT) FILTER (WHERE l_linenumber <> 7) / sum(l_quantity::BIGINT) FILTER (WHERE l_linenumber <> 7) * 100, 6) AS compression_ratio, max(CASE WHEN l_linenumber = 7 THEN l_suppkey END) AS comment_size FROM lineitem")
def inspect_summary(spark, sf_dir):
    return catalog.inspect(_lineitems(spark, sf_dir)).withColumn("compression_ratio", F.round("compression_ratio", 6)).drop("qo_offset", "qo_size", "has_recovery")


@query(
    """
SELECT o_custkey AS archive, o_orderkey AS entry_idx, CASE WHEN n > 3 THEN CASE WHEN r > n - 3 THEN r - (n - 3) END ELSE r END::BIGINT AS new_version
FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY v NULLS LAST, o_orderkey) AS r FROM (
  SELECT o_custkey, o_orderkey, CASE WHEN k > 1 THEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS v FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders)))
"""
)
def versions_keep_n(spark, sf_dir):
    from pyspark.sql import Window

    by = Window.partitionBy("o_custkey")
    orders = _read(spark, sf_dir, "orders").withColumn("k", F.row_number().over(by.orderBy(F.desc("o_orderkey")))).withColumn("v", F.row_number().over(by.orderBy("o_orderkey")))
    entries = orders.select(F.col("o_custkey").alias("archive"), F.col("o_orderkey").alias("entry_idx"), F.lit("f").alias("name"), F.when(F.col("k") > 1, F.col("v").cast("long")).alias("file_version"), F.lit(False).alias("is_service"))
    return catalog.versions(entries, keep=3).select("archive", "entry_idx", "new_version")


@query("SELECT a.o_orderkey AS entry_idx, epoch(a.o_orderdate)::BIGINT + (a.o_orderkey % 3 - 1) AS mtime_unix FROM orders a WHERE a.o_orderkey % 4 <> 0 AND a.o_orderkey % 3 = 2")
def freshen(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_idx"), F.col("o_orderkey").cast("string").alias("name"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"))
    seconds = F.call_function("div", F.col("us"), F.lit(1_000_000))
    disk = orders.select("entry_idx", "name", (seconds + F.col("entry_idx") % 3 - 1).alias("mtime_unix"))
    archived = orders.where("entry_idx % 4 <> 0").select("name", seconds.alias("utime_unix"))
    return catalog.freshen(disk, archived).select("entry_idx", "mtime_unix")


@query("SELECT c_custkey AS key, c_name AS name, 0 AS part FROM customer WHERE c_custkey % 4 <> 1 UNION ALL SELECT c_custkey, c_name, 1 FROM customer WHERE c_custkey % 4 = 1")
def upsert_replace(spark, sf_dir):
    base = _read(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("entry_idx"), F.col("c_custkey").alias("key"))
    added = F.col("entry_idx") > F.col("key")  # the batch's numbers follow all of base
    return catalog.upsert(base, base.where("entry_idx % 4 = 1")).select("key", "name", added.cast("int").alias("part"))


@query(
    """
SELECT conv_id AS archive, turn AS entry_idx FROM (
  SELECT conv_id, turn, turn % 3 <> 0 AS service, turn % 5 = 4 AS comment, last_value(CASE WHEN turn % 3 = 0 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS head FROM conversations)
WHERE NOT (coalesce(head % 2 = 1, false) AND NOT (service AND comment))
"""
)
def delete_children(spark, sf_dir):
    conv = _read(spark, sf_dir, "conversations")
    entries = conv.select(F.col("conv_id").alias("archive"), F.col("turn").alias("entry_idx"), (F.col("turn") % 3 != 0).alias("is_service"), F.when(F.col("turn") % 5 == 4, "CMT").otherwise("STM").alias("service_type"), F.when(F.col("turn") % 2 == 1, "odd").otherwise("even").alias("name"))
    return catalog.delete(entries, ["odd"]).select("archive", "entry_idx")


@query("SELECT conv_id AS archive, turn AS entry_idx, last_value(CASE WHEN turn % 3 = 0 THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS owner_idx FROM conversations")
def owning_file(spark, sf_dir):
    conv = _read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("archive"), F.col("turn").alias("entry_idx"), (F.col("turn") % 3 != 0).alias("is_service"))
    return catalog.owning_file(conv).select("archive", "entry_idx", "owner_idx")


_ITEMS = "SELECT o_custkey AS archive, o_orderkey AS entry_idx, o_orderkey % 11 = 7 AS service, o_orderkey * 7 % 4 AS method, o_orderkey * 5 % 3 <> 0 AS solid, o_orderkey * 3 % 10 = 0 AS removed, o_orderstatus = 'P' AS dir FROM orders"


def _items(spark, sf_dir):
    key = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("archive"), key.alias("entry_idx"), (key % 11 == 7).alias("is_service"), (key * 7 % 4).cast("int").alias("method"), (key * 5 % 3 != 0).alias("is_solid"), (key * 3 % 10 == 0).alias("removed"), (F.col("o_orderstatus") == "P").alias("is_dir"))


_HEADS = f"SELECT *, coalesce(last_value(CASE WHEN NOT service AND method > 0 AND NOT solid THEN entry_idx END IGNORE NULLS) OVER w, -1) AS run_head FROM ({_ITEMS}) WINDOW w AS (PARTITION BY archive ORDER BY entry_idx ROWS UNBOUNDED PRECEDING)"


@query(f"SELECT archive, entry_idx, run_head FROM ({_HEADS})")
def solid_runs(spark, sf_dir):
    return solid.run_heads(_items(spark, sf_dir)).select("archive", "entry_idx", "run_head")


@query(
    f"""SELECT archive, entry_idx, coalesce(last_value(CASE WHEN NOT service AND NOT dir AND method > 0 AND NOT solid THEN entry_idx END IGNORE NULLS) OVER w, min(entry_idx) OVER w) AS reader_head,
  last_value(CASE WHEN NOT service AND NOT dir AND method > 0 THEN entry_idx END IGNORE NULLS) OVER p AS prev_chain FROM ({_ITEMS})
  WINDOW w AS (PARTITION BY archive ORDER BY entry_idx ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY archive ORDER BY entry_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def solid_positions(spark, sf_dir):
    return solid.previous_in_chain(solid.reader_heads(_items(spark, sf_dir))).select("archive", "entry_idx", "reader_head", "prev_chain")


@query(
    f"""SELECT archive, entry_idx, CASE WHEN removed AND last > entry_idx THEN CASE WHEN run_head = entry_idx THEN 'head of solid run' ELSE 'inside solid run' END END AS refusal
FROM (SELECT *, max(CASE WHEN NOT service AND method > 0 AND solid AND NOT removed THEN entry_idx END) OVER (PARTITION BY archive, run_head) AS last FROM ({_HEADS}))"""
)
def solid_delete_guard(spark, sf_dir):
    return solid.delete_guard(_items(spark, sf_dir)).select("archive", "entry_idx", "refusal")


@query(
    f"""SELECT archive, entry_idx, CASE WHEN removed AND NOT service AND method > 0 AND (solid OR kept) THEN 'solid chain' END AS refusal
FROM (SELECT *, bool_or(NOT service AND method > 0 AND solid AND NOT removed) OVER (PARTITION BY archive, run_head) AS kept FROM ({_HEADS}))"""
)
def solid_replace_guard(spark, sf_dir):
    return solid.replace_guard(_items(spark, sf_dir)).select("archive", "entry_idx", "refusal")


@query(
    """
WITH p AS (SELECT o_custkey AS archive, o_orderkey AS i, o_orderkey * 7 % 5 < 3 AS more, o_orderkey * 3 % 4 > 0 AS cont, o_totalprice::BIGINT AS size, o_orderkey * 31 AS crc FROM orders),
s AS (SELECT *, CASE WHEN coalesce(lag(more) OVER (PARTITION BY archive ORDER BY i) AND cont, false) THEN 0 ELSE 1 END AS start FROM p),
g AS (SELECT *, sum(start) OVER (PARTITION BY archive ORDER BY i ROWS UNBOUNDED PRECEDING) AS part FROM s)
SELECT archive, min(i)::BIGINT AS entry_idx, sum(size)::BIGINT AS data_size, arg_max(crc, i) AS crc32, arg_max(more, i) AS split_after, count(*) AS parts FROM g GROUP BY archive, part
"""
)
def split_stitch(spark, sf_dir):
    key = F.col("o_orderkey")
    entries = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("archive"), F.lit(0).alias("volume_idx"), key.alias("entry_idx"), F.lit("f").alias("name"), F.lit(False).alias("is_service"), (key * 7 % 5 < 3).alias("split_after"), (key * 3 % 4 > 0).alias("split_before"), F.bround("o_totalprice").cast("long").alias("data_size"), (key * 31).alias("crc32"), F.lit("v").alias("volume_path"), F.lit(0).cast("long").alias("data_offset"))
    return volumes.stitch(entries).select("archive", "entry_idx", "data_size", "crc32", "split_after", "parts")


@query("SELECT doc_id AS entry_idx, CASE WHEN first < doc_id THEN first END AS master_idx FROM (SELECT doc_id, CASE WHEN strlen(text) >= 64 THEN min(doc_id) OVER (PARTITION BY strlen(text), sha256(text)) ELSE doc_id END AS first FROM documents)")
def dedup_filecopy(spark, sf_dir):
    return dedup.identical(_documents(spark, sf_dir).select("entry_idx", "content"), 64).select("entry_idx", "master_idx")


@query("SELECT event_id AS entry_idx, CASE WHEN first < event_id THEN first END AS master_idx FROM (SELECT event_id, min(event_id) OVER (PARTITION BY user_id, event_type) AS first FROM events)")
def hardlinks(spark, sf_dir):
    files = _read(spark, sf_dir, "events").select(F.col("event_id").alias("entry_idx"), F.col("user_id").alias("dev"), F.col("event_type").alias("ino"))
    return dedup.hardlinks(files).select("entry_idx", "master_idx")


@query(
    """
WITH e AS (SELECT doc_id, source || '/' || (doc_id % 300) AS name, CASE WHEN doc_id % 4 = 0 THEN 5 ELSE 0 END AS type FROM documents),
m AS (SELECT name, min(doc_id) AS master_idx FROM e WHERE type = 0 GROUP BY name)
SELECT doc_id AS entry_idx, master_idx, CASE WHEN master_idx IS NULL THEN 'missing master' END AS error FROM e LEFT JOIN m USING (name) WHERE type = 5
"""
)
def filecopy_resolve(spark, sf_dir):
    name = F.concat_ws("/", "source", (F.col("doc_id") % 300).cast("string"))
    entries = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_idx"), name.alias("name"), F.lit(False).alias("is_service"), F.struct(F.when(F.col("doc_id") % 4 == 0, 5).otherwise(0).alias("type"), name.alias("target")).alias("redir"))
    return dedup.filecopy_masters(entries).select("entry_idx", "master_idx", "error")


@query(
    """
WITH e AS (SELECT page_id AS i, CASE WHEN page_id % 3 = 0 THEN upper(p) ELSE p END AS name, page_id % 2 = 0 AS dir FROM (
  SELECT page_id, 'd' || page_id % 9 || CASE WHEN page_id % 4 = 0 THEN '' ELSE '/f' || page_id % 17 END AS p FROM pages)),
x AS (SELECT a.i, b.i AS j, a.name AS first, b.name AS second, 0 AS r, 'duplicate' AS cls FROM (SELECT min(i) AS i, name FROM e GROUP BY name) a JOIN e b ON a.name = b.name AND a.i < b.i
 UNION ALL SELECT a.i, b.i, e1.name, b.name, 1, 'case_fold' FROM (SELECT min(i) AS i, lower(name) AS f FROM e GROUP BY 2) a JOIN e e1 ON e1.i = a.i JOIN e b ON a.f = lower(b.name) AND a.i < b.i AND e1.name <> b.name
 UNION ALL SELECT a.i, b.i, a.name, b.name, 3, 'file_vs_dir' FROM e a JOIN e b ON NOT a.dir AND starts_with(b.name, a.name || '/'))
SELECT first, second, cls FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY r) AS k FROM x) WHERE k = 1
"""
)
def collisions(spark, sf_dir):
    p = F.concat(F.lit("d"), F.col("page_id") % 9, F.when(F.col("page_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("/f"), F.col("page_id") % 17)))
    entries = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("entry_idx"), F.when(F.col("page_id") % 3 == 0, F.upper(p)).otherwise(p).alias("name"), (F.col("page_id") % 2 == 0).alias("is_dir"))
    return dedup.collisions(entries)


@query(
    """
WITH h AS (SELECT o_custkey AS archive, o_orderkey AS i, 1 + o_totalprice::BIGINT AS size, o_orderkey % 3 AS hole FROM orders),
o AS (SELECT *, sum(size + hole) OVER (PARTITION BY archive ORDER BY i ROWS UNBOUNDED PRECEDING) - size AS off FROM h)
SELECT archive, off::BIGINT AS header_offset, (off - lag(off + size) OVER (PARTITION BY archive ORDER BY off))::BIGINT AS gap FROM o
"""
)
def qo_contiguity(spark, sf_dir):
    from pyspark.sql import Window

    order = Window.partitionBy("archive").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    sized = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("archive"), "o_orderkey", (F.bround("o_totalprice").cast("long") + 1).alias("data_size"))
    headers = sized.withColumn("header_offset", F.sum(F.col("data_size") + F.col("o_orderkey") % 3).over(order) - F.col("data_size")).select("archive", "header_offset", F.lit(0).alias("header_size"), "data_size")
    return volumes.contiguous(headers).select("archive", "header_offset", "gap")


@query(
    """
WITH r AS (SELECT o_custkey AS archive, o_orderkey AS entry_idx, o_totalprice::BIGINT AS s, sum(o_totalprice::BIGINT) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS running_bytes FROM orders),
b AS (SELECT *, CASE WHEN s > 400000 THEN 'member' WHEN running_bytes > 1000000 THEN 'total' END AS breach FROM r)
SELECT archive, entry_idx, running_bytes, breach, bool_or(breach IS NOT NULL) OVER (PARTITION BY archive ORDER BY entry_idx ROWS UNBOUNDED PRECEDING) AS aborted FROM b
"""
)
def limits_cutoff(spark, sf_dir):
    entries = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("archive"), F.col("o_orderkey").alias("entry_idx"), F.bround("o_totalprice").cast("long").alias("unp_size"))
    return catalog.running_limit(entries, 400_000, 1_000_000).select("archive", "entry_idx", "running_bytes", "breach", "aborted")


@query(
    """
WITH t AS (SELECT o_orderkey AS entry_idx, epoch(o_orderdate)::BIGINT AS s FROM orders),
r AS (SELECT entry_idx, CASE WHEN entry_idx % 4 = 0 THEN s - 900000000 WHEN entry_idx % 4 = 1 THEN s + 1 WHEN entry_idx % 4 = 2 THEN s END AS v FROM t)
SELECT entry_idx, least(greatest(v, 0), 32503680000)::BIGINT AS mtime_unix, v <> least(greatest(v, 0), 32503680000) AS mtime_clamped FROM r
"""
)
def mtime_resolve_clamp(spark, sf_dir):
    s = F.call_function("div", F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.lit(1_000_000))
    k = F.col("o_orderkey") % 4
    entries = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_idx"), (k == 0).alias("htime_is_unix"), (s - 900_000_000).alias("htime_mtime_unix"), F.when(k == 1, s + 1).alias("utime_unix"), F.when(k == 2, times.unix_to_filetime(s)).otherwise(0).cast("long").alias("mtime_win"))
    return catalog.resolved_times(entries).select("entry_idx", "mtime_unix", "mtime_clamped")


@query(
    """
WITH t AS (SELECT o_orderkey AS entry_idx, o_orderdate AS d, epoch(o_orderdate)::BIGINT + o_orderkey % 86400 AS s FROM orders),
u AS (SELECT entry_idx, s, make_timestamp(s * 1000000) AS d FROM t)
SELECT entry_idx, (greatest(year(d), 1980) - 1980 << 25) + (month(d) << 21) + (day(d) << 16) + (hour(d) << 11) + (minute(d) << 5) + second(d) // 2 AS dos, s - s % 2 AS back FROM u
"""
)
def dos_time_roundtrip(spark, sf_dir):
    s = F.call_function("div", F.unix_micros(F.col("o_orderdate").cast("timestamp")), F.lit(1_000_000)) + F.col("o_orderkey") % 86400
    dos = times.unix_to_dos(s)
    return _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_idx"), dos.alias("dos"), times.dos_to_unix(dos).cast("long").alias("back"))


@query(
    """
WITH e AS (SELECT doc_id AS entry_idx, doc_id % 6 AS method, n_chars * (1 + doc_id % 977) * 40 AS size FROM documents),
d AS (SELECT *, CASE method WHEN 0 THEN 131072 WHEN 1 THEN 524288 WHEN 2 THEN 1048576 WHEN 3 THEN 8388608 WHEN 4 THEN 16777216 ELSE 67108864 END AS def,
  CASE method WHEN 0 THEN 131072 WHEN 1 THEN 524288 WHEN 2 THEN 2097152 WHEN 3 THEN 67108864 WHEN 4 THEN 67108864 ELSE 268435456 END AS top FROM e)
SELECT entry_idx, CASE WHEN size = 0 THEN def WHEN size < def THEN least(greatest(131072, (2 ** ceil(log2(size)))::BIGINT), def) ELSE least(greatest(def, (2 ** ceil(log2(size)))::BIGINT), top) END::BIGINT AS dict_size FROM d
"""
)
def dict_auto(spark, sf_dir):
    size = F.col("n_chars") * (1 + F.col("doc_id") % 977) * 40
    return _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_idx"), sizes.auto_dict(F.col("doc_id") % 6, size).alias("dict_size"))


@query(
    """
WITH e AS (SELECT o_custkey AS archive, o_orderkey AS entry_idx, o_orderkey % 6 AS method, o_totalprice::BIGINT AS size, o_orderkey % 7 = 0 AS dir, o_orderkey % 5 = 0 AS ref FROM orders),
d AS (SELECT *, method > 0 AND NOT dir AND NOT ref AS packs, CASE method WHEN 1 THEN 524288 WHEN 2 THEN 1048576 WHEN 3 THEN 8388608 WHEN 4 THEN 16777216 ELSE 67108864 END AS win FROM e)
SELECT archive, entry_idx, CASE WHEN packs THEN 'block' ELSE 'stored' END AS decision, CASE WHEN packs THEN win ELSE 0 END::BIGINT AS dict_size,
  greatest(CASE WHEN packs THEN win * 5 + 6291456 ELSE least(size, 16777216) END, 1)::BIGINT AS workspace_bytes,
  coalesce(bool_or(packs) OVER (PARTITION BY archive ORDER BY entry_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AND (packs OR ref) AS solid_chain FROM d
"""
)
def dict_plan(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders")
    entries = orders.select(F.col("o_custkey").alias("archive"), F.col("o_orderkey").alias("entry_idx"), (F.col("o_orderkey") % 6).cast("int").alias("method"), F.bround("o_totalprice").cast("long").alias("raw_size"), (F.col("o_orderkey") % 7 == 0).alias("is_dir"), (F.col("o_orderkey") % 5 == 0).alias("is_reference"))
    return planner.plan(entries, solid=True).select("archive", "entry_idx", "decision", "dict_size", "workspace_bytes", "solid_chain")


@query("SELECT sum(w)::BIGINT AS total_workspace, max(w)::BIGINT AS peak_workspace FROM (SELECT greatest(least(n_chars, 16777216), 1) AS w FROM documents)")
def plan_memory(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.lit(1).alias("archive"), F.col("doc_id").alias("entry_idx"), F.lit(0).alias("method"), F.col("n_chars").alias("raw_size"), F.lit(False).alias("is_dir"), F.lit(False).alias("is_reference"))
    return planner.memory(planner.plan(docs))


@query("SELECT doc_id AS entry_idx, n_chars & 63 AS unp_ver, (n_chars >> 6) & 1 = 1 AS is_solid, (n_chars >> 7) & 7 AS method, ((131072 << (n_chars >> 10) & 31) + CASE WHEN n_chars & 63 > 0 THEN ((131072 << (n_chars >> 10) & 31) // 32) * ((n_chars >> 15) & 31) ELSE 0 END)::BIGINT AS win_size FROM (SELECT doc_id, n_chars % 20000 AS n_chars FROM documents)".replace("131072 << (n_chars >> 10) & 31", "131072 * (1 << ((n_chars >> 10) & 31))"))
def compression_info(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("entry_idx"), *[c.alias(n) for n, c in sizes.compression_fields(F.col("n_chars") % 20000).items()])


@query(
    """
WITH s AS (SELECT doc_id AS entry_idx, n_chars * 37 AS z, doc_id % 120 AS p FROM documents),
d AS (SELECT *, CASE WHEN z >= 204800 THEN 200 ELSE least(greatest((z + 1023) // 1024, 1), 200) END AS d FROM s),
n AS (SELECT *, least(p * d // 100, 10 * d) AS w, (z + d - 1) // d AS g FROM d),
g AS (SELECT *, CASE WHEN w = 0 AND z < 204800 THEN 1 ELSE w END AS nr, g + g % 2 AS gc FROM n),
c AS (SELECT *, greatest((gc + 65535) // 65536, 1) AS scale FROM g)
SELECT entry_idx, d::BIGINT AS d, nr::BIGINT AS nr, gc::BIGINT AS group_count, scale::BIGINT AS scale, ((d * 8 + 72) * scale)::BIGINT AS header_size, ((d * 8 + 72) * scale + gc)::BIGINT AS shard_size FROM c
"""
)
def rr_geometry(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("entry_idx"), *[c.alias(n) for n, c in sizes.recovery_geometry(F.col("n_chars") * 37, F.col("doc_id") % 120).items()])


@query(
    """
WITH s AS (SELECT doc_id, n_chars * 100003 AS z, 1 + doc_id % 50 AS p FROM documents), k AS (SELECT 512 * (1 << i) AS sec FROM range(12) t(i)),
f AS (SELECT doc_id, sec, greatest((z + sec - 1) // sec, 1) AS data, p FROM s, k), c AS (SELECT *, greatest((data * p + 99) // 100, 1) AS rec FROM f),
b AS (SELECT doc_id, arg_min({'s': sec, 'd': data, 'r': rec}, sec) FILTER (WHERE data + rec <= 65530) AS x FROM c GROUP BY doc_id)
SELECT doc_id AS entry_idx, coalesce(x.s, 1048576)::BIGINT AS sector_size, coalesce(x.d, 0)::BIGINT AS data_sectors, coalesce(x.r, 0)::BIGINT AS recovery_sectors FROM b
"""
)
def sector_parameters(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("entry_idx"), *[c.alias(n) for n, c in sizes.sector_parameters(F.col("n_chars") * 100003, 1 + F.col("doc_id") % 50).items()])


@query(
    """
WITH c AS (SELECT user_id AS f, hash(1) AS z, event_type || floor(value)::INT AS h FROM events), n AS (SELECT h, f, count(*) AS n FROM c GROUP BY 1, 2),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY h ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
r AS (SELECT h, f, least(n, 8 - before) AS m FROM b WHERE before < 8),
s AS (SELECT n.f, r.f AS p, sum(n.n * r.m) AS shared FROM n JOIN r ON n.h = r.h AND r.f < n.f GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY f ORDER BY shared DESC, p) AS i FROM s), z AS (SELECT f, count(*) AS size FROM c GROUP BY f)
SELECT k.f AS file_idx, k.p AS partner_idx, k.shared::BIGINT AS shared FROM k JOIN z a ON a.f = k.f JOIN z b ON b.f = k.p WHERE i = 1 AND shared * 1000 >= 300 * least(a.size, b.size)
"""
)
def affinity_pairs(spark, sf_dir):
    chunks = _read(spark, sf_dir, "events").select(F.col("user_id").alias("file_idx"), F.concat("event_type", F.floor("value").cast("int")).alias("hash"))
    return planner.partners(chunks)


@query("SELECT s_suppkey AS id, floor((0.6 * (s_acctbal + 1000) + 0.4 * s_nationkey) / 10)::BIGINT AS score, row_number() OVER (ORDER BY floor((0.6 * (s_acctbal + 1000) + 0.4 * s_nationkey) / 10)::BIGINT DESC, s_suppkey) AS rank FROM supplier")
def rank_scores(spark, sf_dir):
    records = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), leaderboard.score(F.col("s_acctbal") + 1000, F.col("s_nationkey").cast("double")).alias("score"))
    return leaderboard.ranked(records, order="id")


@query("SELECT s_suppkey AS id, s_acctbal AS score FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def leaderboard_top(spark, sf_dir):
    return leaderboard.top(_read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score")), 10, order="id")


@query("SELECT user_id AS label, r[len(r) // 2 + 1] AS median, r[1] AS min, round((r[len(r)] - r[1]) / r[len(r) // 2 + 1], 9) AS spread FROM (SELECT user_id, list_sort(list(value + 1)) AS r FROM events GROUP BY user_id)")
def bench_median_spread(spark, sf_dir):
    runs = _read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("label")).agg(F.collect_list(F.col("value") + 1).alias("runs"))
    s = leaderboard.run_summary(F.col("runs"))
    return runs.select("label", s["median"].alias("median"), s["min"].alias("min"), F.round(s["spread"], 9).alias("spread"))


@query(
    """
SELECT source, count(*) AS tested_entries, sum(n_chars)::BIGINT AS tested_bytes, count(*) FILTER (WHERE doc_id % 10 = 3) AS matched_entries,
  count(*) FILTER (WHERE doc_id % 10 = 3 AND (coalesce(quality, 1) = 0 OR doc_id % 7 = 0)) AS errors, count(*) FILTER (WHERE doc_id % 10 = 3 AND doc_id % 7 = 0) AS skipped,
  CASE WHEN count(*) FILTER (WHERE doc_id % 10 = 3 AND doc_id % 7 = 0) > 0 THEN 11 WHEN count(*) FILTER (WHERE doc_id % 10 = 3 AND (coalesce(quality, 1) = 0 OR doc_id % 7 = 0)) > 0 THEN 3 ELSE 0 END AS exit_code
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
"""
)
def verify_totals(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    tested = docs.select("source", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"), F.col("n_chars").alias("unp_size"), F.lit(False).alias("is_service"), (F.col("quality") == 1).alias("ok"), (F.col("doc_id") % 7 == 0).alias("locked"))
    return catalog.verify_totals(tested, include=["*3"], by=["source"])


@query(
    """
WITH e AS (SELECT o_custkey AS archive, o_orderkey AS entry_idx, o_orderkey % 900 AS size, sum(o_orderkey % 900) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM orders),
v AS (SELECT *, e - size AS b, unnest(range((e - size) // 1000, (e - 1) // 1000 + 1)) AS volume_idx FROM e WHERE size > 0)
SELECT archive, entry_idx, volume_idx, greatest(b, volume_idx * 1000) - volume_idx * 1000 AS "offset", greatest(b, volume_idx * 1000) - b AS "begin", least(e, (volume_idx + 1) * 1000) - greatest(b, volume_idx * 1000) AS size FROM v
"""
)
def volume_extents(spark, sf_dir):
    entries = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("archive"), F.col("o_orderkey").alias("entry_idx"), (F.col("o_orderkey") % 900).alias("pack_size"))
    return volumes.slices(entries, 1000).select("archive", "entry_idx", "volume_idx", "offset", "begin", "size")


@query("SELECT page_id AS entry_idx, CASE WHEN u = '' THEN 'empty' WHEN starts_with(u, '/') THEN 'leading slash' WHEN contains(u, chr(92)) THEN 'backslash' WHEN regexp_matches(u, '(^|/)\\.\\.(/|$)') THEN 'dot-dot segment' WHEN page_id % 2 = 0 AND NOT ends_with(u, '/') THEN 'directory without trailing slash' WHEN page_id % 2 = 1 AND ends_with(u, '/') THEN 'file with trailing slash' END AS problem FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN '/' || url WHEN 2 THEN url || chr(92) WHEN 3 THEN url || '/../x' ELSE url END AS u FROM pages)")
def path_problems(spark, sf_dir):
    k, url = F.col("page_id") % 6, F.col("url")
    u = F.when(k == 0, "").when(k == 1, F.concat(F.lit("/"), url)).when(k == 2, F.concat(url, F.lit("\\"))).when(k == 3, F.concat(url, F.lit("/../x"))).otherwise(url)
    return _read(spark, sf_dir, "pages").select(F.col("page_id").alias("entry_idx"), paths.problem(u, F.col("page_id") % 2 == 0).alias("problem"))


@query("SELECT page_id AS entry_idx, regexp_replace(regexp_replace(regexp_replace(split_part(url, '://', 2), '[?:*|<>\"]', '_', 'g'), '/+', '/', 'g'), '[./ ]+$', '') AS path FROM pages WHERE NOT regexp_matches(url, '[. ]/|/[. ]')")
def sanitised_paths(spark, sf_dir):
    return _sanitised(_read(spark, sf_dir, "pages").where(~F.col("url").rlike(r"[. ]/|/[. ]")))


@query(None)
def sanitised_all_paths(spark, sf_dir):
    """Also the paths that the SQL of sanitised_paths leaves out."""
    return _sanitised(_read(spark, sf_dir, "pages"))


@query("SELECT c_custkey AS id, regexp_extract(c_name, '^(.*?)[0-9]+$', 1) || lpad((c_custkey + 1)::VARCHAR, greatest(len(regexp_extract(c_name, '([0-9]+)$', 1)), len((c_custkey + 1)::VARCHAR))::INT, '0') || '.rar' AS next, regexp_extract(c_name, '^(.*?)[0-9]+$', 1) || lpad('1', len(regexp_extract(c_name, '([0-9]+)$', 1))::INT, '0') || '.rar' AS first FROM customer")
def volume_names(spark, sf_dir):
    name = F.concat("c_name", F.lit(".rar"))
    return _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), paths.next_volume(name).alias("next"), paths.first_volume(name).alias("first"))


@query("SELECT o_orderkey AS entry_idx FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 3 = 2")
def version_filter(spark, sf_dir):
    orders = _read(spark, sf_dir, "orders").withColumn("version", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") % 3))
    return orders.where(masks.version_visible(F.col("o_orderpriority"), F.col("version"), 2)).select(F.col("o_orderkey").alias("entry_idx"))


@query("SELECT target, 'duplicate target' AS conflict FROM (SELECT source AS target FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT source || '/' || doc_id FROM documents WHERE doc_id % 2 = 1) GROUP BY target HAVING count(*) > 1 UNION ALL SELECT DISTINCT a.source, 'file above another' FROM documents a JOIN documents b ON a.source = b.source AND a.doc_id % 2 = 0 AND b.doc_id % 2 = 1")
def target_conflicts(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    target = F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise(F.concat_ws("/", "source", F.col("doc_id").cast("string")))
    return dedup.target_conflicts(docs.select(target.alias("target"), F.lit(False).alias("is_dir")))


@query(None)
def blake2sp_digest(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return docs.select("entry_idx", F.hex(kernels.blake2sp_column(F.col("content").cast("binary"))).alias("blake2sp"), F.hex(kernels.crc64_column(F.col("content").cast("binary"))).alias("crc64"))


@query(None)
def cdc_chunks(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("entry_idx", F.explode(kernels.chunks_column(F.col("content").cast("binary"))).alias("c"))
    return docs.select("entry_idx", "c.offset", "c.length", "c.hash")


@query(None)
def gf_parity(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("entry_idx", F.col("content").cast("binary").alias("content"))
    return recovery.protect(docs, 5).select("entry_idx", "d", "nr", F.sha2(F.unhex(F.coalesce(F.array_join(F.transform("parity", F.hex), ""), F.lit(""))), 256).alias("parity_sha256"))


@query("SELECT doc_id AS entry_idx, lower(to_base(crc, 16, 8)) AS crc32, coalesce(length(text), 0) AS size FROM (SELECT doc_id, text, doc_id * 2654435761 % 4294967296 AS crc FROM documents)")
def list_technical(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("entry_idx"), F.lower(catalog.crc_text(F.col("doc_id") * 2654435761 % 4294967296)).alias("crc32"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
