"""Catalog operators: listing, filtering, diff, update, delete, versions, tallies.

Every operator takes a frame with some columns of the entry schema and works on any such
frame. Partition columns (``by``) let one plan treat many archives at once, so windows over
archive order never gather more than an archive.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import masks as m
from ..functions import paths, times

CHILDLESS = ("QO", "CMT", "RR")  # services of the archive, not of the file before them


def crc_text(crc: Column) -> Column:
    return F.lpad(F.hex(F.coalesce(crc, F.lit(0))), 8, "0")


def visible(entries: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), case_sensitive: bool = True) -> DataFrame:
    """Entries that listing shows: no services, no excluded, those that a mask includes."""
    name = F.col("name")
    return entries.where(~F.coalesce(F.col("is_service"), F.lit(False)) & ~m.excluded(name, list(exclude), case_sensitive) & m.included(name, list(include), case_sensitive))


def list_entries(entries: DataFrame, view: str = "l", include: Sequence[str] = (), exclude: Sequence[str] = (), case_sensitive: bool = True) -> DataFrame:
    """Views l and v (the same), lb bare names, lt technical, json, abi (catalog rows) and full."""
    shown = visible(entries, include, exclude, case_sensitive)
    packed = F.coalesce("pack_size", F.lit(0).cast("long")).alias("packed_size")
    if view in ("l", "v"):
        return shown.select("entry_idx", F.col("unp_size").alias("size"), "name")
    if view == "lb":
        return shown.select("entry_idx", F.concat_ws(";", "name", F.col("file_version").cast("string")).alias("name"))
    if view == "lt":
        w = F.col("win_size")
        folded = F.when(w % (1 << 20) == 0, F.concat((w / (1 << 20)).cast("long"), F.lit(" MB"))).when(w % 1024 == 0, F.concat((w / 1024).cast("long"), F.lit(" KB"))).otherwise(F.concat(w, F.lit(" bytes")))
        return shown.select("entry_idx", "name", F.col("unp_size").alias("size"), packed, "method", crc_text(F.col("crc32")).alias("crc32"), F.when(w > 0, folded).alias("dictionary"), "file_version", "owner")
    if view == "json":
        row = F.struct("name", F.col("unp_size").alias("unpacked_size"), packed, "method", crc_text(F.col("crc32")).alias("crc32"), F.col("is_solid").alias("solid"), "is_dir", F.col("win_size").alias("dictionary_bytes"))
        return shown.select("entry_idx", F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))
    if view == "abi":
        return shown.select("entry_idx", F.col("name").alias("path"), "is_dir", "method", F.col("crypt").isNotNull().alias("is_encrypted"), F.coalesce("crc32", F.lit(0).cast("long")).alias("crc32"), F.col("unp_size").alias("size"), packed, "mtime")
    if view == "full":
        return entries
    raise ValueError(f"no view {view!r}")


def safe_attributes(mode: Column, umask: int = 0o022, keep_setid: bool = False) -> Column:
    """Mode bits for extraction: no set-id bits unless asked for, and the umask applied."""
    kept = mode.bitwiseAND(0o7777 if keep_setid else 0o777)
    return kept.bitwiseAND(~umask & 0o7777)


# ---------------------------------------------------------------- diff


def last_by_path(entries: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The last entry of each path, with the columns to compare."""
    keyed = entries.withColumn("path", paths.diff_key(F.col("name"))).where("path <> ''")
    return keyed.groupBy("path").agg(F.max_by(F.struct(*keep), "entry_idx").alias("e")).select("path", "e.*")


def diff(old: DataFrame, new: DataFrame, strict: bool = False) -> DataFrame:
    """path and kind: added, deleted, modified (size or crc), metadata_diff (time or method), identical.
    Absent sums compare as 0. strict also compares digests and dictionaries."""
    content, meta = ["unp_size", "crc32", *(["blake2sp"] if strict else [])], ["mtime_win", "method", *(["win_size"] if strict else [])]
    columns = content + meta
    sides = [last_by_path(f, columns).select("path", F.lit(True).alias(f"in_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in columns]) for f, s in ((old, "old"), (new, "new"))]
    both = sides[0].join(sides[1], "path", "full_outer")

    def differ(names):
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)) if not c.endswith("blake2sp") else F.col(c)
        out = F.lit(False)
        for c in names:
            out |= ~zero(f"old_{c}").eqNullSafe(zero(f"new_{c}"))
        return out

    kind = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "deleted").when(differ(content), "modified").when(differ(meta), "metadata_diff").otherwise("identical")
    return both.withColumn("kind", kind).drop("in_old", "in_new")


def diff_rows(compared: DataFrame) -> DataFrame:
    """The rows of a diff that differ, sorted by the bytes of their paths."""
    return compared.where("kind <> 'identical'").orderBy("path")


def diff_summary(compared: DataFrame) -> DataFrame:
    return compared.groupBy("kind").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- update


def freshen(disk: DataFrame, archived: DataFrame) -> DataFrame:
    """Files on disk whose name is archived with an older time. disk: name, mtime_unix; archived: name, utime_unix."""
    newest = archived.groupBy("name").agg(F.max("utime_unix").alias("archived_mtime"))
    return disk.join(newest, "name").where(F.col("mtime_unix") > F.col("archived_mtime"))


def upsert(base: DataFrame, batch: DataFrame, key: str = "name", order: str = "entry_idx", by: Sequence[str] = (), renumber: bool = True) -> DataFrame:
    """base without the batch's names, then the batch. The order column stays a number: the batch
    counts on from the largest of base (of each ``by``), in its own order; without renumber its
    numbers stay as they are."""
    retained = base.join(batch.select(*by, key).distinct(), [*by, key], "left_anti")
    if not renumber:
        return retained.unionByName(batch, allowMissingColumns=True)
    top = base.groupBy(*by).agg((F.max(order) + 1).alias("_top"))
    first = batch.groupBy(*by).agg(F.min(order).alias("_first"))
    moved = batch.join(first, list(by), "left").join(top, list(by), "left") if by else batch.crossJoin(first).crossJoin(top)  # single rows
    moved = moved.withColumn(order, (F.col(order) - F.col("_first") + F.coalesce("_top", F.lit(0))).cast(base.schema[order].dataType)).drop("_first", "_top")
    return retained.unionByName(moved, allowMissingColumns=True)


def delete_at(entries: DataFrame, offsets: DataFrame, by: Sequence[str] = ("archive",)) -> DataFrame:
    """Entries that stay when the files whose headers stand at these offsets (by, header_offset) go, with their own services."""
    gone = entries.join(offsets.select(*by, "header_offset").distinct(), [*by, "header_offset"], "left_semi").select(*by, "entry_idx").withColumn("_hit", F.lit(True))
    marked = entries.join(gone, [*by, "entry_idx"], "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))
    order = Window.partitionBy(*by).orderBy("entry_idx").rowsBetween(Window.unboundedPreceding, 0)
    file_gone = F.coalesce(F.last(F.when(~F.col("is_service"), F.col("_hit")), True).over(order), F.lit(False))
    kept_service = F.col("is_service") & F.coalesce(F.col("service_type"), F.lit("")).isin(*CHILDLESS)
    return marked.withColumn("_gone", file_gone & ~kept_service).where(~F.col("_gone")).drop("_hit", "_gone")


def owning_file(entries: DataFrame, by: Sequence[str] = ("archive",)) -> DataFrame:
    """owner_idx: for a service the file entry before it, for a file itself."""
    order = Window.partitionBy(*by).orderBy("entry_idx").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("owner_idx", F.last(F.when(~F.col("is_service"), F.col("entry_idx")), True).over(order))


def delete(entries: DataFrame, include: Sequence[str], by: Sequence[str] = ("archive",), case_sensitive: bool = True) -> DataFrame:
    """Entries that stay when the masks' files go; a file's own services go with it."""
    hit = ~F.col("is_service") & m.included(F.col("name"), list(include), case_sensitive) if include else F.lit(False)
    marked = owning_file(entries, by).withColumn("_hit", hit)
    order = Window.partitionBy(*by).orderBy("entry_idx").rowsBetween(Window.unboundedPreceding, 0)
    gone = F.last(F.when(~F.col("is_service"), F.col("_hit")), True).over(order)
    kept_service = F.col("is_service") & F.coalesce(F.col("service_type"), F.lit("")).isin(*CHILDLESS)
    return marked.withColumn("_gone", F.coalesce(gone, F.lit(False)) & ~kept_service).where(~F.col("_gone")).drop("_hit", "_gone")


def versions(entries: DataFrame, keep: int = 0, by: Sequence[str] = ("archive", "name")) -> DataFrame:
    """File versions when every name gets a new current entry: entry_idx, new_version (null: pruned).

    History by version, then unnumbered entries. More than ``keep`` (if not 0): the oldest go
    and the rest count from 1; else only the unnumbered get the numbers after the highest.
    """
    name = Window.partitionBy(*by)
    age = name.orderBy(F.col("file_version").asc_nulls_last(), "entry_idx")
    ranked = entries.where("NOT coalesce(is_service, false)").withColumns({"_n": F.count("*").over(name), "_r": F.row_number().over(age), "_top": F.coalesce(F.max("file_version").over(name), F.lit(0)), "_numbered": F.count("file_version").over(name)})
    pruned = (F.col("_n") > keep) if keep > 0 else F.lit(False)
    kept_number = F.col("_r") - (F.col("_n") - keep)
    plain = F.coalesce(F.col("file_version"), F.col("_top") + F.col("_r") - F.col("_numbered"))
    return ranked.withColumn("new_version", F.when(pruned, F.when(kept_number > 0, kept_number)).otherwise(plain).cast("long")).drop("_n", "_r", "_top", "_numbered")


# ---------------------------------------------------------------- tallies


def inspect(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of files, directories and links (in this order of precedence: directory, link), of
    encrypted files, sizes, the largest dictionary, the ratio in percent, and the services."""
    file = ~F.coalesce(F.col("is_service"), F.lit(False))
    is_dir, link = F.coalesce(F.col("is_dir"), F.lit(False)), F.coalesce(F.col("redir.type"), F.lit(0)) != 0
    total = F.coalesce(F.sum(F.when(file, F.col("unp_size"))), F.lit(0))
    packed = F.coalesce(F.sum(F.when(file, F.col("pack_size"))), F.lit(0))
    service = lambda kind, c, how: how(F.when(F.col("service_type") == kind, F.col(c)))
    return entries.groupBy(*by).agg(
        F.count_if(file & ~is_dir & ~link).alias("file_count"),
        F.count_if(file & is_dir).alias("dir_count"),
        F.count_if(file & ~is_dir & link).alias("link_count"),
        F.count_if(file & F.col("crypt").isNotNull()).alias("encrypted_files"),
        total.alias("total_unpacked_bytes"),
        packed.alias("total_packed_bytes"),
        F.coalesce(F.max(F.when(file, F.col("win_size"))), F.lit(0)).alias("max_dictionary_bytes"),
        F.when(total > 0, packed / total * 100).otherwise(0.0).alias("compression_ratio"),
        F.coalesce(F.bool_or(F.col("service_type") == "CMT"), F.lit(False)).alias("has_comment"),
        service("CMT", "data_size", F.max).alias("comment_size"),
        service("QO", "data_offset", F.max).alias("qo_offset"),
        service("QO", "data_size", F.max).alias("qo_size"),
        F.coalesce(F.bool_or(F.col("service_type") == "RR"), F.lit(False)).alias("has_recovery"),
    )


def verify_totals(tested: DataFrame, exclude: Sequence[str] = (), include: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Totals of a test run. tested: name, unp_size, is_service, ok (null: not checked), locked (no
    password). Masks narrow what is matched, not the totals; a locked entry is skipped and an error."""
    shown = tested.where(~F.coalesce(F.col("is_service"), F.lit(False)) & ~m.excluded(F.col("name"), list(exclude)))
    matched = m.included(F.col("name"), list(include))
    locked = F.coalesce(F.col("locked"), F.lit(False))
    bad = matched & (locked | ~F.coalesce(F.col("ok"), F.lit(True)))
    return shown.groupBy(*by).agg(
        F.count("*").alias("tested_entries"),
        F.coalesce(F.sum("unp_size"), F.lit(0)).alias("tested_bytes"),
        F.count_if(matched).alias("matched_entries"),
        F.count_if(bad).alias("errors"),
        F.count_if(matched & locked).alias("skipped"),
        F.when(F.count_if(matched & locked) > 0, 11).when(F.count_if(bad) > 0, 3).otherwise(0).alias("exit_code"),
    )


def running_limit(entries: DataFrame, member_cap: int, total_cap: int, by: Sequence[str] = ("archive",)) -> DataFrame:
    """running_bytes and breach (member, total, null): a cap itself is allowed; the first breach ends an archive."""
    order = Window.partitionBy(*by).orderBy("entry_idx").rowsBetween(Window.unboundedPreceding, 0)
    summed = entries.withColumn("running_bytes", F.sum("unp_size").over(order))
    breach = F.when(F.col("unp_size") > member_cap, "member").when(F.col("running_bytes") > total_cap, "total")
    return summed.withColumn("breach", breach).withColumn("aborted", F.coalesce(F.max(F.col("breach").isNotNull()).over(order), F.lit(False)))


def header_limit(headers: DataFrame, count_cap: int, bytes_cap: int, by: Sequence[str] = ("archive",)) -> DataFrame:
    """header_count and header_bytes so far, over all volumes of a set, and header_breach (count, bytes, null); a cap itself is allowed."""
    order = Window.partitionBy(*by).orderBy("volume_idx", "header_offset").rowsBetween(Window.unboundedPreceding, 0)
    counted = headers.withColumn("header_count", F.count("*").over(order)).withColumn("header_bytes", F.sum("header_size").over(order))
    return counted.withColumn("header_breach", F.when(F.col("header_count") > count_cap, "count").when(F.col("header_bytes") > bytes_cap, "bytes"))


def printed(entries: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """Contents of the files that masks choose, to print in archive order."""
    return visible(entries, include, exclude).where("NOT coalesce(is_dir, false)").select("entry_idx", "name", "content")


def print_exit_code(entries: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """files and exit_code: 10 where masks choose no file, else 0."""
    return printed(entries, include, exclude).agg(F.count("*").alias("files")).withColumn("exit_code", F.when(F.col("files") == 0, 10).otherwise(0))


def displayed(text: Column, columns: int | None = None) -> Column:
    """A name for a terminal: escape sequences and control characters off, broken UTF-8 as U+FFFD,
    cut to so many characters with an ellipsis as the last."""
    plain = F.regexp_replace(F.make_valid_utf8(text), r"\x1b(\[[0-?]*[ -/]*[@-~])?|[\x00-\x1f\x7f-\x9f]", "")
    return plain if columns is None else F.when(F.length(plain) > columns, F.concat(F.substring(plain, 1, max(columns - 1, 0)), F.lit("\u2026" if columns else ""))).otherwise(plain)


#: Namespaces of extended attributes (fixed values).
XATTR_SAFE = ("user.", "com.apple.metadata:", "com.apple.metadata.")
XATTR_SECURITY = ("security.", "trusted.")
XATTR_CONTENT = ("com.apple.ResourceFork", "com.apple.FinderInfo")


def stored_xattrs(xattrs: Column) -> Column:
    """The extended attributes that an archive may take, by name."""
    name = lambda x: x["name"].cast("string")
    allowed = lambda x: F.lit(False) | reduce(lambda a, p: a | name(x).startswith(p), (*XATTR_SAFE, *XATTR_SECURITY), name(x).isin(*XATTR_CONTENT))
    return F.array_sort(F.filter(xattrs, allowed))


def restored_xattrs(xattrs: Column, security: bool = False, apple: bool = False) -> Column:
    """The extended attributes that extraction sets: security ones on demand, Apple's contents on Apple hosts."""
    name = lambda x: x["name"].cast("string")
    prefixes = (*XATTR_SAFE, *(XATTR_SECURITY if security else ()))
    return F.filter(xattrs, lambda x: reduce(lambda a, p: a | name(x).startswith(p), prefixes, name(x).isin(*XATTR_CONTENT) if apple else F.lit(False)))


def resolved_times(entries: DataFrame) -> DataFrame:
    """mtime_unix of the best source, clamped to 1970..3000, and whether that changed it."""
    value = times.resolved_mtime(F.col("htime_is_unix"), F.col("htime_mtime_unix"), F.col("utime_unix"), F.col("mtime_win"))
    inside, moved = times.clamped(F.col("mtime_unix"))
    return entries.withColumn("mtime_unix", value).withColumn("mtime_clamped", moved).withColumn("mtime_unix", inside)


def report_json(entries: DataFrame, *columns: str) -> DataFrame:
    """One JSON text per row, fields in the given order, broken UTF-8 as U+FFFD."""
    fixed = [F.make_valid_utf8(F.col(c)).alias(c) if entries.schema[c].dataType.typeName() == "string" else F.col(c) for c in columns]
    return entries.select(F.to_json(F.struct(*fixed), {"ignoreNullFields": "false"}).alias("json"))
