"""Wildcard masks as regular expressions, and predicates built from several of them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(mask: str, case_sensitive: bool = True) -> str:
    """``*`` is any run, slashes included; ``?`` any one code point; the whole name must match."""
    parts = {"*": ".*", "?": "."}
    body = "".join(parts.get(c) or re.sub(r"([^0-9A-Za-z_/])", r"\\\1", c) for c in mask)
    return f"(?s{'' if case_sensitive else 'iu'})\\A{body}\\z"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def matches(path: Column, mask: str, case_sensitive: bool = True) -> Column:
    return path.rlike(glob_regex(mask, case_sensitive))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def included(path: Column, masks: list[str], case_sensitive: bool = True) -> Column:
    """No masks include all; else the whole name or its last component matches one."""
    if not masks:
        return F.lit(True)
    return _any([matches(c, m, case_sensitive) for m in masks for c in (path, basename(path))])


def slashed(path: Column) -> Column:
    """Slashes forward and a leading ./ off."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def excluded(path: Column, patterns: list[str], case_sensitive: bool = True) -> Column:
    """A pattern with a slash is for the whole path, or with a trailing slash for all below it;
    one without is for the last component or the whole path."""
    path, found = slashed(path), []
    for p in (q.replace("\\", "/").removeprefix("./") for q in patterns):
        found.append(matches(path, p, case_sensitive))
        if "/" not in p:
            found.append(matches(basename(path), p, case_sensitive))
        elif p.endswith("/"):
            found.append(path.startswith(p))
    return _any(found)


def version_visible(name: Column, version: Column, requested: int | None = None, masks: tuple[str, ...] = ()) -> Column:
    """Versions at extraction: by default those without a number, or named as name;N by a mask;
    0 shows all, N only that one."""
    if requested == 0:
        return F.lit(True)
    if requested:
        return F.coalesce(version == requested, F.lit(False))
    full = F.concat_ws(";", name, version.cast("string"))
    explicit = _any([matches(c, m, False) for m in masks if ";" in m for c in (full, basename(full))])
    return version.isNull() | explicit
