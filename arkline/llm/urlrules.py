"""URL filtering with rules indexed by their rarest literal token.

Only DataFrame functions: a URL's tokens fetch the rules that are filed under one of
them, and only those rules' regular expressions run. A rule is filed under the complete
literal token of its pattern that the fewest URLs hold, counted over all URLs; a rule
without any is filed under the empty token, which every URL has, so no match is lost.

Rules are a parameter of at most MAX_BROADCAST_RULES rows when broadcast; a longer list
joins by shuffle, its hot tokens left to the skew join.

Defined results: a null URL, or one without "://", has empty host and path and no rule,
and the verdict "allow"; repeated rows are judged one by one; other columns are carried
along unless they are called like a result column, which then replaces them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_RULES = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKEN = r"[0-9a-z%]+"
_ROW, _KEY, _URL, _HOST, _PATH, _TOK = "_ark_row", "_ark_key", "_ark_url", "_ark_host", "_ark_path", "_ark_tok"


@dataclass(frozen=True)
class Rule:
    """rank: the larger wins. site: the pattern reads host + path, else the whole URL in lower case."""

    name: str
    pattern: str
    tokens: tuple[str, ...]
    action: str
    rank: int
    site: bool


def site_rule(host: str, path: str, action: str) -> Rule:
    """Fits a host with its subdomains where the URL's path starts with path; the longest wins."""
    # a token of the path counts as complete only before a further separator
    inner = re.findall(rf"{_TOKEN}(?=[^0-9a-z%])", path.lower())
    return Rule(host + path, rf"^(?:[^/?#]*\.)?{_quoted(host)}{_quoted(path)}", tuple(dict.fromkeys([*re.findall(_TOKEN, host), *inner])), action, len(host + path), True)


def pattern_rule(text: str) -> Rule:
    """A filter-list rule: || begins at a host label, | at an end, * is any run, ^ a separator or the end, @@ allows."""
    action, body = ("allow", text[2:]) if text.startswith("@@") else ("block", text)
    body = body.lower()
    lead, rest = (r"^[^/?#]*://(?:[^/?#]*\.)?", body[2:]) if body.startswith("||") else ("^", body[1:]) if body.startswith("|") else ("", body)
    tail, rest = ("$", rest[:-1]) if rest.endswith("|") else ("", rest)
    regex = "".join(".*" if c == "*" else r"(?:[^0-9a-z%._-]|$)" if c == "^" else _quoted(c) for c in rest)
    whole = ("/" if lead else "*") + rest + ("/" if tail else "*")
    tokens = re.findall(rf"(?<![0-9a-z%*]){_TOKEN}(?![0-9a-z%*])", whole)
    return Rule(text, f"(?s){lead}{regex}{tail}", tuple(dict.fromkeys(tokens)), action, len(text), False)


def _quoted(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z_])", lambda m: "\\" + m[1] if m[1].isascii() else m[1], text)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, _UPPER, _LOWER)


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(url: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(lower_ascii(F.coalesce(url, F.lit(""))), F.lit(f"({_TOKEN})"), 1)))


def rule_index(rules: list[Rule], urls: DataFrame) -> DataFrame:
    """A row for each rule, with the token it is filed under. urls has one column, the URL."""
    spark = urls.sparkSession
    text = lambda values: F.array(*map(F.lit, values))
    rows = [F.struct(F.lit(r.name).alias("name"), F.lit(r.pattern).alias("pattern"), text(r.tokens or ("",)).alias("tokens"), F.lit(r.action).alias("action"), F.lit(r.rank).alias("rank"), F.lit(r.site).alias("site")) for r in rules]
    table = spark.range(1).select(F.inline(F.array(*rows)))
    filed = table.select("*", F.explode("tokens").alias("token"))
    wanted = filed.select(F.col("token").alias("_want")).distinct()
    if len(rules) <= MAX_BROADCAST_RULES:
        wanted = F.broadcast(wanted)
    seen = urls.select(F.explode(_tokens(urls[urls.columns[0]])).alias("_seen"))
    counts = seen.join(wanted, F.col("_seen") == F.col("_want")).groupBy("_seen").count()
    ranked = filed.join(counts, F.col("token") == F.col("_seen"), "left").withColumn("n", F.coalesce("count", F.lit(0)))
    best = ranked.groupBy("name", "pattern", "action", "rank", "site").agg(F.min(F.struct("n", "token")).alias("best"))
    return best.select("name", "pattern", "action", "rank", "site", F.col("best.token").alias("filed"))


def judge_urls(df: DataFrame, rules: list[Rule], url_col: str = "url") -> DataFrame:
    """df with host, path, rule (the winning site rule, else null) and verdict."""
    url = df[url_col].cast("string")
    index = rule_index(rules, df.select(url.alias(_URL)))
    # a rule that every URL meets keeps rows that meet no other, so nothing is joined back
    every = df.sparkSession.range(1).select(F.lit("").alias("name"), F.lit("").alias("pattern"), F.lit("allow").alias("action"), F.lit(-1).alias("rank"), F.lit(False).alias("site"), F.lit("").alias("filed"))
    index = index.unionByName(every).select(*[F.col(c).alias(f"_ark_{c}") for c in index.columns])
    if len(rules) <= MAX_BROADCAST_RULES:
        index = F.broadcast(index)
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    rows = df.select(*[df[c] for c in kept], url.alias(_URL), url_host(url).alias(_HOST), url_path(url).alias(_PATH), F.monotonically_increasing_id().alias(_ROW))
    narrow = rows.select(_ROW, _URL, _HOST, _PATH, *kept).withColumn(_TOK, F.explode(_tokens(F.col(_URL))))
    target = F.when(F.col("_ark_site"), F.concat(_HOST, _PATH)).otherwise(lower_ascii(F.coalesce(_URL, F.lit(""))))
    met = narrow.join(index, F.col(_TOK) == F.col("_ark_filed")).where((F.col("_ark_rank") < 0) | F.rlike(target, F.col("_ark_pattern")))
    hit = F.struct(F.col("_ark_rank").alias("rank"), F.col("_ark_name").alias("name"), F.col("_ark_action").alias("action"))
    pattern = ~F.col("_ark_site") & (F.col("_ark_rank") >= 0)
    judged = met.groupBy(_ROW).agg(
        *[F.any_value(c).alias(f"_ark_keep{i}") for i, c in enumerate([_HOST, _PATH, *kept])],
        F.max(F.when(F.col("_ark_site"), hit)).alias("_ark_won"),
        F.bool_or(pattern & (F.col("_ark_action") == "block")).alias("_ark_blocked"),
        F.bool_or(pattern & (F.col("_ark_action") == "allow")).alias("_ark_allowed"),
    )
    verdict = F.coalesce(F.col("_ark_won.action"), F.when(F.col("_ark_blocked") & ~F.col("_ark_allowed"), "block").otherwise("allow"))
    out = [F.col("_ark_keep0").alias("host"), F.col("_ark_keep1").alias("path"), F.col("_ark_won.name").alias("rule"), verdict.alias("verdict")]
    return judged.select(*[F.col(f"_ark_keep{i + 2}").alias(c) for i, c in enumerate(kept)], *out)


#: Fixed rules of the query: (host, path, action).
SITE_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Filter-list rules for hosts of adverts, bets and spam.
PATTERN_RULES = ["||cheap-pills.", "||casino-win.", "||free-bets.", "||spam-farm.", "||ads-track.", "||adserver.", "||doubleclick.", "/popunder.", "/adframe/", "@@||ads-track.*/privacy/"]


def default_rules() -> list[Rule]:
    return [*(site_rule(*r) for r in SITE_RULES), *(pattern_rule(p) for p in PATTERN_RULES)]


def op9(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, default_rules()).select("page_id", "host", "path", "rule", "verdict")


_CASES = " ".join(f"WHEN starts_with(path, '{p}') AND (host = '{h}' OR ends_with(host, '.{h}')) THEN '{h}{p}'" for h, p, _ in sorted(SITE_RULES, key=lambda r: -len(r[0] + r[1])))
_BLOCK = " OR ".join(f"contains('.' || host, '.{p[2:]}')" for p in PATTERN_RULES if p.startswith("||"))
ORACLE = rf"""
WITH parts AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (SELECT *, CASE {_CASES} END AS rule FROM parts),
method AS (SELECT *, (({_BLOCK} OR contains(lower(url), '/popunder.') OR contains(lower(url), '/adframe/'))
  AND NOT (contains('.' || host, '.ads-track.') AND contains(lower(url), '/privacy/'))) AS blocked FROM ruled)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ({", ".join(f"'{h}{p}'" for h, p, a in SITE_RULES if a == "allow")}) THEN 'allow'
       WHEN rule IS NOT NULL THEN 'block' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM method
"""
