"""Secret scans over an incremental blob ledger.

A text is a blob, named by its SHA-256, however many rows or versions hold it. The ledger
is a Parquet table of blobs with the rule versions they were ever scanned for, also without a
finding; a scan takes the (blob, rule version) pairs that are missing there, adds them, and
joins the findings back to every row that holds the blob. A new rule version therefore scans
every blob once more, for that rule alone. ``Ledger.compact`` merges the batches of many scans.

Scale: one shuffle of digests finds the unseen pairs. Texts don't move: a filter of a bounded
size tells the tasks that read them which blobs have anything unseen (what it lets through
besides is dropped again by the join with the unseen pairs), a task scans a blob once however
many rows hold it, and results are one small row a blob. Findings come back by blob in a join
whose hot side can be split.

Defined results: a null text is the empty blob, without findings; repeated rows get the
same findings; positions count code points, ends are exclusive; invalid UTF-8 reads as
U+FFFD. Result columns replace input columns of the same name.

Scans note a private key by its BEGIN line, as their SQL does. Redaction takes the key whole:
to the END line of the same label if no other BEGIN comes first, else over the lines of
base64 that follow.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import set_aside
from .filters import BitFilter
from .workspace import Workspace


@dataclass(frozen=True)
class Rule:
    """A match counts if its group has at least ``least`` characters. hints: one of these is
    in the lower-cased text, or there is no match."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1
    hints: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
#: Fixed patterns, in the order of their kinds; the first three are the base.
RULES = (
    Rule("assign", 1, rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, ("password", "passwd", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 16, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]+", 0, 32),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, ("private key-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, ("eyj",)),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]+", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]+", 0, 20, ("xox",)),
)
BASE = ("assign", "access", "hex")
_BREAK = r"(?:\s|\\[rn])"  # line ends may be escaped
_KEY = (
    r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(?:(?:(?!-----BEGIN )[\s\S])*?-----END \1PRIVATE KEY-----"
    rf"|(?:{_BREAK}*(?:Proc-Type|DEK-Info):[^\r\n\\]*)*"
    rf"(?:{_BREAK}*+[A-Za-z0-9+/]{{40,}}+={{0,2}}|{_BREAK}++[A-Za-z0-9+/]++={{0,2}}(?=[ \t]*(?:[\r\n]|\\[rn]|\Z)))*+)"
)
#: The rules of redaction, which hides keys with their bodies.
WHOLE = tuple(Rule("pem", 2, _KEY, r.group, r.least, r.hints) if r.kind == "pem" else r for r in RULES)
_HEX_RUN = re.compile(r"[0-9a-f]{32,}")


def spans_of(rule: Rule, text: str, lowered: str) -> list[tuple[int, int]]:
    if rule.hints and not any(h in lowered for h in rule.hints):
        return []
    if rule.pattern == r"[0-9a-f]+" and rule.least == 32:  # maximal runs, found at once
        return [m.span() for m in _HEX_RUN.finditer(text)]
    return [m.span() for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least]


_FINDINGS = "array<struct<start: long, kind: string, end: long>>"


def _blob(c):
    return F.unhex(F.sha2(F.coalesce(c.cast("binary"), F.lit(b"").cast("binary")), 256))


class Ledger:
    """Scanned blobs in a folder of batches: blob binary, rules (names with versions), findings."""

    SCHEMA = "blob binary, rules array<string>, findings array<struct<rule: string, start: long, end: long>>"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def rows(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).option("recursiveFileLookup", "true").parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(self.SCHEMA)])

    def add(self, scanned: DataFrame) -> str:
        """A batch in a folder of its own, so a failed one leaves no half-read rows."""
        batch = uuid.uuid4().hex
        scanned.write.parquet(f"{self.path}/{batch}")
        return batch

    def compact(self) -> None:
        """All batches as one, a row for each blob. Not beside a scan; if it is cut off, the batches
        that are left only repeat what the new one holds."""
        rows = self.rows()
        if rows.isEmpty():
            return
        merged = rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"), F.array_distinct(F.flatten(F.collect_list("findings"))).alias("findings"))
        batch = self.add(merged)
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for x in files.listStatus(folder):
            if x.getPath().getName() != batch:
                files.delete(x.getPath(), True)


def _unseen(docs: DataFrame, ledger: Ledger, space: Workspace, text_col: str, names: list[str]) -> DataFrame | None:
    """_todo_blob and _todo_rules: what the ledger has nothing of; None: it is empty."""
    seen = ledger.rows()
    if seen.isEmpty():
        return None
    blobs = docs.select(_blob(docs[text_col]).alias("_todo_blob")).distinct()
    seen = seen.groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("rules"))
    rules = F.array(*map(F.lit, names))
    met = blobs.join(seen, F.col("_todo_blob") == F.col("blob"), "left")
    return space.table(met.select("_todo_blob", F.array_except(rules, F.coalesce("rules", F.array().cast("array<string>"))).alias("_todo_rules")).where(F.size("_todo_rules") > 0))


def _scanned(docs: DataFrame, text_col: str, todo: DataFrame | None, rules: tuple[Rule, ...]) -> DataFrame:
    """A ledger batch: the unseen blobs with what they were scanned for."""
    names = [r.name for r in rules]
    if todo is None:
        told = None
    else:
        whole = todo.where(F.size("_todo_rules") == len(names)).select("_todo_blob")
        partly = todo.where(F.size("_todo_rules") < len(names))
        missing = {r[0] for r in partly.select(F.explode("_todo_rules")).distinct().collect()}
        told = BitFilter(whole, "_todo_blob"), BitFilter(partly.select("_todo_blob"), "_todo_blob"), missing
    told = docs.sparkSession.sparkContext.broadcast(told)

    def run(batches):
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        done: set[bytes] = set()
        for batch in batches:
            blobs, found = [], []
            for raw in batch.column(0):
                raw = raw.as_py() or b""
                blob = hashlib.sha256(raw).digest()
                if blob in done:
                    continue
                if told.value is None or blob in told.value[0]:
                    own = rules
                elif blob in told.value[1]:
                    own = [r for r in rules if r.name in told.value[2]]
                else:
                    continue
                if len(done) >= 50_000:
                    done.clear()
                done.add(blob)
                text = raw.decode("utf-8", "replace")
                lowered = text.lower()
                blobs.append(blob)
                found.append([{"rule": r.name, "start": a, "end": b} for r in own for a, b in spans_of(r, text, lowered)])
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(found, kind)], names=["blob", "findings"])

    source = docs.select(docs[text_col].cast("binary").alias("_ark_text"))
    rows = source.mapInArrow(run, "blob binary, findings array<struct<rule: string, start: long, end: long>>").dropDuplicates(["blob"])
    if todo is None:
        return rows.select("blob", F.array(*map(F.lit, names)).alias("rules"), "findings")
    met = rows.join(todo, F.col("blob") == F.col("_todo_blob"))
    return met.select("blob", F.col("_todo_rules").alias("rules"), F.filter("findings", lambda f: F.array_contains("_todo_rules", f["rule"])).alias("findings"))


def scan(docs: DataFrame, ledger: Ledger, space: Workspace, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with _blob and findings (all spans by start, then kind as listed)."""
    names = [r.name for r in rules]
    ledger.add(_scanned(docs, text_col, _unseen(docs, ledger, space, text_col, names), rules))
    place = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.name, i)])
    kind = F.create_map(*[F.lit(x) for r in rules for x in (r.name, r.kind)])
    hits = ledger.rows().select("blob", F.filter("findings", lambda f: f["rule"].isin(names)).alias("findings")).where(F.size("findings") > 0)
    each = F.transform("findings", lambda s: F.struct(s["start"].alias("start"), F.element_at(place, s["rule"]).alias("at"), F.element_at(kind, s["rule"]).alias("kind"), s["end"].alias("end")))
    found = hits.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(each)))).alias("f"))
    found = space.table(found.select(F.col("blob").alias("_found_blob"), F.transform("f", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("_ark_found")))
    named = docs.select(*[docs[c] for c in docs.columns if c != "findings"], _blob(docs[text_col]).alias("_ark_blob"))
    joined = named.join(found, F.col("_ark_blob") == F.col("_found_blob"), "left")
    return joined.withColumn("findings", F.coalesce("_ark_found", F.array().cast(_FINDINGS))).drop("_ark_found", "_found_blob")


def hidden(text: str, findings: list) -> str:
    """text with [kind] in place of its findings, which come by start; one that begins inside another is covered by it."""
    out, to = [], 0
    for f in findings:
        if f["start"] >= to:
            out += [text[to : f["start"]], f"[{f['kind']}]"]
        to = max(to, f["end"])
    return "".join([*out, text[to:]])


def redact(docs: DataFrame, ledger: Ledger, space: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every finding in the text replaced by [kind]; texts without one stay as they are and never leave the JVM."""
    docs, own = set_aside(docs, ["findings"])
    found = scan(docs, ledger, space, id_col, text_col, WHOLE)

    @F.pandas_udf("string")
    def cut(texts: pd.Series, findings: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else hidden(bytes(t).decode("utf-8", "replace"), f) for t, f in zip(texts, findings, strict=True)], dtype=object)

    hit = F.size("findings") > 0
    return own(found.withColumn(text_col, F.coalesce(cut(F.when(hit, F.col(text_col).cast("binary")), F.when(hit, F.col("findings"))), F.col(text_col))))


def _listed(findings):
    return F.array_join(F.transform(findings, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6(spark, sf_dir):
    space = Workspace(spark, "secrets")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs, Ledger(spark, space.subdir("ledger")), space)
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("findings", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("findings")).alias("spans"))


def _sql(i: int, r: Rule) -> str:
    p = r.pattern.replace("'", "''")
    value = f"regexp_extract(m, '{p}', {r.group})" if r.group else "m"
    return f"""SELECT doc_id, s, {i} AS nth, '{r.kind}' AS kind, s + length(m) AS e FROM (
  SELECT doc_id, split_part(parts[i + 1], chr(2), 1) AS m, list_sum(list_transform(parts[1:i], lambda x: length(x)))::BIGINT - (i - 1) AS s FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts))) AS i FROM (
      SELECT doc_id, string_split(regexp_replace(text, '{p}', chr(1) || '\\0' || chr(2), 'g'), chr(1)) AS parts FROM documents WHERE text IS NOT NULL)))
  WHERE length({value}) >= {r.least}"""


ORACLE = f"""
WITH hits AS ({" UNION ALL ".join(_sql(i, r) for i, r in enumerate(RULES))}),
listed AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) FILTER (WHERE nth < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, nth) AS spans FROM hits GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN listed USING (doc_id)
"""
