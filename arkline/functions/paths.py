"""Path rules as column expressions: normal forms, validity, hardening, archive names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Device names that can't be file names (fixed values).
RESERVED = (
    "con prn aux nul com0 com1 com2 com3 com4 com5 com6 com7 com8 com9 "
    "lpt0 lpt1 lpt2 lpt3 lpt4 lpt5 lpt6 lpt7 lpt8 lpt9 conin$ conout$ clock$"
).split()
MAX_PATH_BYTES = 2048


def diff_key(path: Column) -> Column:
    """Slashes forward, none trailing; the key two catalogs are compared by."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "/+$", "")


def problem(path: Column, is_dir: Column) -> Column:
    """Why a path can't be written, by the first rule it breaks; null if it can. path may be binary."""
    raw = path.cast("binary")
    text = F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string"))
    ends = text.endswith("/")
    return (
        F.when(F.octet_length(raw) == 0, "empty")
        .when(F.octet_length(raw) > MAX_PATH_BYTES, "too long")
        .when(text.isNull(), "invalid UTF-8")
        .when(text.startswith("/"), "leading slash")
        .when(text.rlike(r"^[^\x00-\x1f\\]*\x00"), "NUL byte")
        .when(text.rlike(r"^[^\x00-\x1f\\]*[\x01-\x1f]"), "control character")
        .when(text.contains("\\"), "backslash")
        .when(text.rlike(r"(^|/)\.\.(/|$)"), "dot-dot segment")
        .when(is_dir & ~ends, "directory without trailing slash")
        .when(~is_dir & ends, "file with trailing slash")
    )


def safe_component(item: Column) -> Column:
    """A name every file system takes: forbidden characters as _, no trailing dots or blanks,
    device names behind a _."""
    clean = F.regexp_replace(F.regexp_replace(item, r'[\x00-\x1f<>"|?*:]', "_"), r"[. ]+$", "")
    stem = F.lower(F.regexp_replace(F.substring_index(clean, ".", 1), r"[. ]+$", ""))
    return F.when(clean == "", "_").when(stem.isin(RESERVED), F.concat(F.lit("_"), clean)).otherwise(clean)


def sanitised(path: Column) -> Column:
    """A relative path that stays below its root: drive and leading slashes off, . skipped,
    .. takes the part before it off, every part made safe."""
    body = F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "^[A-Za-z]:", ""), "^/+", "")
    none = F.array().cast("array<string>")
    parts = F.aggregate(
        F.split(body, "/"),
        none,
        lambda done, p: F.when((p == "") | (p == "."), done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(safe_component(p)))),
    )
    return F.array_join(parts, "/")


def archive_name(full: Column, base: str = "", mode: str = "") -> Column:
    """The name an added file gets: ep last component, ep1 without base, ep2 without drive, ep3 as it is."""
    full, base = F.translate(full, "\\", "/"), base.replace("\\", "/")
    if mode == "ep":
        return F.substring_index(full, "/", -1)
    if mode == "ep3":
        return full
    if mode == "ep2":
        return sanitised(F.regexp_replace(full, "^[A-Za-z]:", ""))
    if not base:
        return sanitised(full)
    rest = F.regexp_replace(F.substring(full, len(base) + 1, 1 << 30), "^/+", "")
    return F.when(full.startswith(base), rest).otherwise(sanitised(full))


def short_alias(path: Column) -> Column:
    """Whether a component's stem looks like an 8.3 alias (a tilde before a digit)."""
    return path.rlike(r"(^|/)[^/.]*~[0-9]")


def contained(path: Column, root: str) -> Column:
    """Whether the hardened path stays below root (always, unless it is empty)."""
    full = F.concat(F.lit(root.rstrip("/") + "/"), sanitised(path))
    return full.startswith(root.rstrip("/") + "/") & (sanitised(path) != "")


def ancestors(path: Column) -> Column:
    """All strict component prefixes of a path, the shortest first."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    lengths = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(lengths, lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def link_escapes(path: Column, target: Column) -> Column:
    """Whether a link's relative target leads above the root from where the link stands."""
    depth = F.greatest(F.size(F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))) - 1, F.lit(0))
    steps = F.split(F.translate(target, "\\", "/"), "/")
    state = F.aggregate(
        steps,
        F.struct(depth.alias("at"), F.lit(False).alias("out")),
        lambda s, p: F.struct((s["at"] + F.when((p == "") | (p == "."), 0).when(p == "..", -1).otherwise(1)).alias("at"), (s["out"] | ((p == "..") & (s["at"] <= 0))).alias("out")),
    )
    return target.rlike(r"^([/\\]|[A-Za-z]:)") | state["out"]


def next_volume(name: Column, old_numbering: bool = False) -> Column:
    """The name of the volume after this one; equal to it where the old scheme has no further name."""
    if old_numbering:
        stem, ext = F.regexp_replace(name, r"\.[^.]*$", ""), F.regexp_extract(name, r"\.([^.]*)$", 1)
        letter, number = F.substring(ext, 1, 1), F.try_to_number(F.regexp_extract(ext, r"([0-9]{2})$", 1), F.lit("99")).cast("int")
        following = F.chr(F.ascii(letter) + 1)
        rolled = F.when(letter.between("a", "y"), F.concat(stem, F.lit("."), following, F.lit("00"))).otherwise(name)
        counted = F.concat(stem, F.lit("."), F.substring(ext, 1, 1), F.lpad((number + 1).cast("string"), 2, "0"))
        return F.when(number.isNull(), F.concat(stem, F.lit(".r00"))).when(number == 99, rolled).otherwise(counted)
    ext = F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))
    named = F.when(ext == "", F.concat(name, F.lit(".rar"))).when(ext == ".", F.concat(name, F.lit("rar"))).when(ext.isin(".exe", ".sfx"), F.regexp_replace(name, r"\.[^.]*$", ".rar")).otherwise(name)
    digits = F.regexp_extract(named, r"([0-9]+)[^0-9]*$", 1)
    raised = (F.when(digits == "", F.lit("0")).otherwise(digits).cast("decimal(38,0)") + 1).cast("string")
    width = F.greatest(F.length(digits), F.length(raised))
    head, tail = F.regexp_extract(named, r"^(.*?)[0-9]+[^0-9]*$", 1), F.regexp_extract(named, r"[0-9]+([^0-9]*)$", 1)
    first = F.concat(F.regexp_replace(named, r"\.[^.]*$", ""), F.lit(".part01"), F.regexp_extract(named, r"(\.[^.]*)$", 1))
    return F.when(digits == "", first).otherwise(F.concat(head, F.lpad(raised, width, "0"), tail))


def first_volume(name: Column, old_numbering: bool = False) -> Column:
    """The first volume of a set: the last run of digits as 0...01, or .rar for the old scheme."""
    if old_numbering:
        return F.concat(F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(".rar"))
    digits = F.regexp_extract(name, r"([0-9]+)[^0-9]*$", 1)
    head, tail = F.regexp_extract(name, r"^(.*?)[0-9]+[^0-9]*$", 1), F.regexp_extract(name, r"[0-9]+([^0-9]*)$", 1)
    return F.when(digits == "", next_volume(name)).otherwise(F.concat(head, F.lpad(F.lit("1"), F.length(digits), "0"), tail))
