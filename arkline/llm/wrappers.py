"""Main text of web pages by union-free wrappers inferred per host.

A wrapper is a regular expression without alternatives over a page's tokens: fixed tags and
texts, text slots, optional parts and repeated parts, nested like the elements. Pages of a
host are aligned one after another: neighbours of one shape fold into a repeated part (also
sequences of up to PERIOD elements), elements that only one side has become optional, and
texts that differ become slots. Aligning two wrappers works the same way, so tasks align
their own pages first and only wrappers travel. An element whose children don't settle into
few parts is generalised to a repeated group of optional repeated parts, which keeps a
wrapper's size bounded by its distinct labels.

The wrapper says which element holds a host's article: an article or main element, else the
deepest one with all text that isn't fixed, without parts that are navigation, adverts,
notices, forms or comments by their tag or name. A text of any length is fixed if it stands
at one place (the labels down to it) of every page with text of a host and these pages have
at least FIXED_PAGES different texts, so copies and repeated rows are one page; a wrapper
carries the digests of these texts, however its parts were generalised. Outside article and
main, fixed texts are dropped at their place as part of the template, unless nothing else is
left of a page. A page that lacks the wrapper's article element is taken as a wrapper of its
own.

Defined results: a null or tagless html is text of its own (null: empty); unclosed, stray
and cut tags are tolerated; equal pages give equal texts; a null URL, or one without "://",
has the host "". Result columns replace input columns of the same name.
"""

from __future__ import annotations

import hashlib
import html as _html
import json
import re
import zlib
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .urlrules import url_host
from .workspace import Workspace

PERIOD = 4
MOST_PARTS = 40
DEEPEST = 150  # in a wrapper, elements nested deeper become siblings
HOSTS_HELD = 2000
FIXED_PAGES = 3
LONGEST_SHOWN = 200  # in an expression, longer texts are shown as their digest
SALTS = (256, 16)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
_words = lambda text: frozenset(text.split())
#: Fixed names: elements by what they are for.
RAW = _words("script style textarea title noscript template iframe svg math noembed noframes xmp canvas object")
UNSEEN = _words("script style noscript template")
VOID = _words("area base br col embed hr img input link meta param source track wbr")
INLINE = _words("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr center")
CELLS = _words("td th")
DROPPED = _words("head nav header footer aside form script style noscript template iframe svg math button select option textarea dialog menu object canvas audio video noembed noframes xmp title input fieldset")
NOISE = _words("ad ads adv advert advertisement advertising adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations sidebar sidebars rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments commentlist disqus respond reply replies skip hidden login search")
CONTENT = _words("article content post entry story main body text")
NOISY_ROLES = _words("navigation banner contentinfo complementary search form dialog alert menu menubar")
#: Which open elements a tag ends.
CLOSES = {"p": _words("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul figure"), "li": _words("li"), "dt": _words("dt dd"), "dd": _words("dt dd"), "tr": _words("tr tbody tfoot thead"), "td": _words("td th tr"), "th": _words("td th tr"), "option": _words("option")}
_ENDS = {tag: [k for k, tags in CLOSES.items() if tag in tags] for tag in frozenset().union(*CLOSES.values())}


class Element:
    """place: a number for the labels from the page down to it."""

    __slots__ = ("tag", "label", "noise", "kids", "place")

    def __init__(self, tag, label, noise, above=0):
        self.tag, self.label, self.noise, self.kids = tag, label, noise, []
        self.place = zlib.crc32(label.encode("utf-8", "surrogatepass") + b"/", above)


def _named(tag: str, attributes: str) -> tuple[str, bool]:
    """(label, whether it is noise): the tag with its names, digits off."""
    noise, names = tag in DROPPED, []
    if attributes and ("class" in attributes or "id" in attributes or "role" in attributes or "CLASS" in attributes or "ID" in attributes):
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                for name in value.lower().split():
                    name = re.sub(r"\d+", "", name)
                    names.append(name)
                    words = set(re.split(r"[^a-z]+", name))
                    noise |= not NOISE.isdisjoint(words) or "header" in words and CONTENT.isdisjoint(words)
            elif key == "role":
                noise |= value.lower() in NOISY_ROLES
                names += ["main"] if value.lower() == "main" else []
            else:
                noise |= key == "hidden" or value.lower() == "true"
    return ".".join([tag, *sorted(set(names))]), noise


def parse(html: str) -> Element:
    """The page as a tree of block elements and texts; inline tags are seen through."""
    root = Element("", "", False)
    stack, at, n = [root], 0, len(html)
    labels: dict = {}
    opened: Counter = Counter()

    def close(k):
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            stack[-1].kids.append(html[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(html[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            stack[-1].kids.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = m[2] or m[5]
        if tag is None or not m[0].endswith(">"):
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if opened[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            elif tag == "p":
                stack[-1].kids.append(Element("p", "p", False))
            continue
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*>|\Z", re.I).search(html, at)
            at = end.end()
            stack[-1].kids.append(Element(tag, tag, True))
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].kids.append(" " if tag == "br" else Element("hr", "hr", False))
            continue
        key = (tag, attributes)
        named = labels.get(key)
        if named is None:
            named = labels[key] = _named(tag, attributes)
        if tag in INLINE and not named[1]:
            continue
        for k in range(len(stack) - 1, 0, -1) if any(opened[x] for x in _ENDS.get(tag, ())) else ():
            open_tag = stack[k].tag
            if tag in CLOSES.get(open_tag, ()):
                close(k)
                break
            if open_tag not in CLOSES and open_tag not in INLINE:
                break
        element = Element(tag, *named, stack[-1].place)
        stack[-1].kids.append(element)
        if not attributes.endswith("/"):
            stack.append(element)
            opened[tag] += 1
    return root


# ---------------------------------------------------------------- wrappers

# a part of a wrapper: [label, optional, repeated, fixed text or None, parts, noise, pages, characters,
# a slot: digest of its texts while all pages have the same;
# the root: digests of up to FIXED_PAGES different pages, and of all texts with their places that every page has]
LABEL, OPTIONAL, REPEATED, TEXT, PARTS, NOISY, PAGES, SIZE, SAME = range(9)
_SLOT = "#"
_GROUP = "()"


def _digest(*texts: str) -> str:
    return hashlib.blake2b("\0".join(texts).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def _at(place: int, text: str) -> str:
    return _digest(str(place), text)


def wrapper_of(root: Element) -> list:
    """The wrapper of one page, folded; without parts if the page has no text but noise."""
    texts: list[tuple[int, str]] = []
    whole = _wrapper_of(root, texts, root.noise, 1)
    if texts:
        whole[SAME] = [[_digest(*(t for _, t in texts))], sorted({_at(*x) for x in texts})]
    else:
        whole[PARTS] = []
    return whole


def _wrapper_of(element: Element, texts: list[tuple[int, str]], noise: bool, depth: int) -> list:
    """The wrapper of an element; its texts outside noise are added to texts."""
    parts = _parts(element, texts, noise, depth)
    if depth == DEEPEST:
        for below, hidden in _below(element):
            parts.append([below.label, False, False, None, fold(_parts(below, texts, noise or hidden, None)), hidden, 1, 0, None])
    return [element.label, False, False, None, fold(parts), element.noise, 1, 0, None]


def _parts(element: Element, texts: list[tuple[int, str]], noise: bool, depth: int | None) -> list:
    """Slots for the element's own texts and, above DEEPEST, the wrappers of its elements."""
    parts, text = [], []

    def flush():
        value = _clean("".join(text))
        text.clear()
        if value:
            digest = _digest(value)
            parts.append([_SLOT, False, False, value if len(value) <= LONGEST_SHOWN else f"\0{digest}", [], False, 1, len(value), digest])
            if not noise:
                texts.append((element.place, value))

    for kid in element.kids:
        if isinstance(kid, str):
            text.append(kid)
        elif kid.tag not in RAW:
            flush()
            if depth is not None and depth < DEEPEST:
                parts.append(_wrapper_of(kid, texts, noise or kid.noise, depth + 1))
    flush()
    return parts


def _shape(part: list) -> str:
    return part[LABEL] if part[LABEL] != _GROUP else f"({' '.join(_shape(p) for p in part[PARTS])})"


def fold(parts: list) -> list:
    """Tandem repeats become one repeated part; many unsettled parts one general group."""
    for period in range(1, PERIOD + 1):
        out: list = []
        for part in parts:
            out.append(part)
            while len(out) >= 2 * period and [_shape(p) for p in out[-period:]] == [_shape(p) for p in out[-2 * period : -period]]:
                merged = [align(a, b, together=True) for a, b in zip(out[-2 * period : -period], out[-period:], strict=True)]
                del out[-2 * period :]
                if period == 1:
                    merged[0][REPEATED] = True
                    out += merged
                else:
                    out.append([_GROUP, False, True, None, merged, False, merged[0][PAGES], 0, None])
                    break
            if period > 1 and len(out) >= period + 1 and out[-period - 1][LABEL] == _GROUP and [_shape(p) for p in out[-period:]] == [_shape(p) for p in out[-period - 1][PARTS]]:
                group = out[-period - 1]
                group[PARTS] = [align(a, b, together=True) for a, b in zip(group[PARTS], out[-period:], strict=True)]
                del out[-period:]
        parts = out
    if len(parts) > MOST_PARTS:
        by_shape: dict = {}
        for part in _ungrouped(parts):
            known = by_shape.get(part[LABEL])
            by_shape[part[LABEL]] = part if known is None else align(known, part, together=True)
        general = list(by_shape.values())
        for part in general:
            part[OPTIONAL] = part[REPEATED] = True
        parts = [[_GROUP, True, True, None, general, False, max(p[PAGES] for p in general), 0, None]]
    return parts


def _ungrouped(parts: list) -> list:
    return [x for p in parts for x in (_ungrouped(p[PARTS]) if p[LABEL] == _GROUP else [p])]


def align(a: list, b: list, together: bool = False) -> list:
    """The wrapper of both; together: both are parts of the same pages."""
    pages = max(a[PAGES], b[PAGES]) if together else a[PAGES] + b[PAGES]
    text = a[TEXT] if a[TEXT] == b[TEXT] else None
    if isinstance(a[SAME] or b[SAME], list):  # roots
        if not a[PARTS] or not b[PARTS]:  # pages without text say nothing of the others
            whole = a if a[PARTS] else b
            return [*whole[:PAGES], pages, a[SIZE] + b[SIZE], whole[SAME]]
        same = [sorted({*a[SAME][0], *b[SAME][0]})[:FIXED_PAGES], sorted(set(a[SAME][1]) & set(b[SAME][1]))]
    elif together:
        same = _digest(a[SAME], b[SAME]) if a[SAME] and b[SAME] else None
    else:
        same = a[SAME] if a[SAME] == b[SAME] else None
    # names don't tell all that makes noise, so a part is noise only if it is on all pages
    return [a[LABEL], a[OPTIONAL] or b[OPTIONAL], a[REPEATED] or b[REPEATED], text, _aligned(a[PARTS], b[PARTS], together), a[NOISY] and b[NOISY], pages, a[SIZE] + b[SIZE], same]


def _aligned(xs: list, ys: list, together: bool) -> list:
    shapes = [_shape(x) for x in xs], [_shape(y) for y in ys]
    if shapes[0] == shapes[1]:
        return [align(x, y, together) for x, y in zip(xs, ys, strict=True)]
    # the longest common subsequence stays; what only one side has becomes optional
    n, m = len(xs), len(ys)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if shapes[0][i] == shapes[1][j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and shapes[0][i] == shapes[1][j]:
            out.append(align(xs[i], ys[j], together))
            i, j = i + 1, j + 1
        else:
            left = j == m or i < n and best[i + 1][j] >= best[i][j + 1]
            part = list(xs[i] if left else ys[j])
            part[OPTIONAL] = True
            out.append(part)
            i, j = i + left, j + (not left)
    return fold(out)


def expression(part: list) -> str:
    """The wrapper as text: # slots, ? optional, + repeated, * both."""
    inner = " ".join(expression(p) for p in part[PARTS])
    body = (json.dumps(part[TEXT]) if part[TEXT] is not None else _SLOT) if part[LABEL] == _SLOT else f"({inner})" if part[LABEL] == _GROUP else f"<{part[LABEL]}>({inner})"
    return body + ("*" if part[OPTIONAL] and part[REPEATED] else "?" if part[OPTIONAL] else "+" if part[REPEATED] else "")


# ---------------------------------------------------------------- where the article is


def _tag(label: str) -> str:
    return label.split(".")[0]


def _is_noise(part: list, path: tuple[str, ...]) -> bool:
    if _tag(part[LABEL]) == "header" and any(_tag(p) == "article" for p in path) and _holds(part, "h1"):
        return False  # an article's own heading
    return part[NOISY]


def _holds(part: list, tag: str) -> bool:
    return any(_tag(p[LABEL]) == tag or _holds(p, tag) for p in part[PARTS])


def locate(root: list) -> tuple[str, ...]:
    """The labels from the root down to the element that holds the article."""
    found: dict[str, tuple] = {}
    weights: dict[tuple, int] = {}
    several = _several(root)

    def walk(part, path, optional):
        """Characters of texts that aren't fixed."""
        own = 0
        for p in part[PARTS]:
            if p[LABEL] == _SLOT:
                own += 0 if several and not optional and not p[OPTIONAL] and p[SAME] else p[SIZE]
            elif p[LABEL] == _GROUP:
                own += walk(p, path, optional or p[OPTIONAL])
            elif not _is_noise(p, path):
                tag, names, below = _tag(p[LABEL]), p[LABEL].split(".")[1:], (*path, p[LABEL])
                if tag in ("article", "main") or "main" in names:
                    kind = tag if tag in ("article", "main") else "main"
                    found.setdefault(kind, below)
                inner = walk(p, below, optional or p[OPTIONAL])
                weights[below] = weights.get(below, 0) + inner
                own += inner
        return own

    total = walk(root, (), False)
    for kind in ("article", "main"):
        if kind in found:
            return found[kind]
    if not total:
        return ()
    # the deepest element that has all of that text and is made to hold blocks, or is called so
    holds = lambda label: _tag(label) in ("div", "section", "body", "td", "html") or not CONTENT.isdisjoint(re.split(r"[^a-z]+", ".".join(label.split(".")[1:])))
    return max((p for p, w in weights.items() if w == total and holds(p[-1])), key=len, default=())


def _several(root: list) -> bool:
    return root[SAME] is not None and len(root[SAME][0]) >= FIXED_PAGES


def plan_of(root: list) -> dict:
    path = locate(root)
    strict = bool(path) and (_tag(path[-1]) in ("article", "main") or "main" in path[-1].split("."))
    return {"path": path, "fixed": root[SAME][1] if _several(root) and not strict else []}


# ---------------------------------------------------------------- extraction


def _clean(text: str) -> str:
    return " ".join(_html.unescape(text).split())


def _holders(element: Element, path, depth=0):
    if depth == len(path):
        yield element
        return
    if depth == DEEPEST - 1:  # the outermost below, as the wrapper has them as siblings
        stack = [element]
        while stack:
            kid = stack.pop()
            if kid is not element and kid.label == path[depth]:
                yield kid
            else:
                stack += [k for k in reversed(kid.kids) if not isinstance(k, str)]
        return
    for kid in element.kids:
        if not isinstance(kid, str) and kid.label == path[depth]:
            yield from _holders(kid, path, depth + 1)


def _blocks(element: Element, out: list[tuple[int, str]], inside: bool) -> None:
    """Adds (place, text) of each block."""
    text: list[str] = []

    def flush(place):
        value = _clean("".join(text))
        text.clear()
        if value:
            out.append((place, value))

    stack = [(element, iter(element.kids), inside)]
    while stack:
        element, kids, inside = stack[-1]
        for kid in kids:
            if isinstance(kid, str):
                text.append(kid)
                continue
            if kid.noise:
                heading = kid.tag == "header" and inside and any(k.tag == "h1" for k, _ in _below(kid))
                if heading or kid.tag not in INLINE and kid.tag not in UNSEEN:
                    flush(element.place)
                if not heading:
                    continue
            elif element.tag == "tr" and kid.tag in CELLS and all(isinstance(k, str) for k in kid.kids):
                text += [" ", *kid.kids, " "]
                continue
            else:
                flush(element.place)
            stack.append((kid, iter(kid.kids), inside or kid.tag == "article"))
            break
        else:
            flush(element.place)
            stack.pop()


def _below(element: Element):
    """(element, whether it or one around it is noise) of all elements below, in order."""
    stack = [(element, False)]
    while stack:
        at, noise = stack.pop()
        if at is not element:
            yield at, noise
        stack += [(k, noise or k.noise) for k in reversed(at.kids) if not isinstance(k, str)]


def main_text(html: str, plan: dict | None) -> str:
    tree = parse(html)
    found = list(_holders(tree, plan["path"])) if plan is not None and plan["path"] else []
    if not found:
        if plan is None or plan["path"]:
            plan = plan_of(wrapper_of(tree)) | {"fixed": []}
        found = list(_holders(tree, plan["path"])) or [tree]
    out: list[tuple[int, str]] = []
    for holder in found:
        _blocks(holder, out, any(_tag(p) == "article" for p in plan["path"]))
    fixed = set(plan["fixed"])
    return "\n\n".join(text for _, text in ([x for x in out if _at(*x) not in fixed] if fixed else out) or out)


# ---------------------------------------------------------------- Spark


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, pages and wrapper (JSON) of every host, aligned over all of its pages."""
    source = pages.select(url_host(pages[url_col].cast("string")).alias("host"), pages[html_col].cast("binary").alias("html"))

    def align_own(batches):
        held: dict[str, list] = {}

        def flush():
            rows = [(h, w[PAGES], json.dumps(w)) for h, w in held.items()]
            held.clear()
            return pa.RecordBatch.from_pydict({"host": pa.array([r[0] for r in rows], pa.string()), "pages": pa.array([r[1] for r in rows], pa.int64()), "wrapper": pa.array([r[2] for r in rows], pa.string())})

        for batch in batches:
            for host, html in zip(batch[0], batch[1], strict=True):
                own = wrapper_of(parse((html.as_py() or b"").decode("utf-8", "replace")))
                known = held.get(host.as_py())
                held[host.as_py()] = own if known is None else align(known, own)
            if len(held) > HOSTS_HELD:
                yield flush()
        yield flush()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        wrapper = None
        for text in sorted(group["wrapper"]):
            other = json.loads(text)
            wrapper = other if wrapper is None else align(wrapper, other)
        return pd.DataFrame({"host": [group["host"].iloc[0]], "pages": [int(group["pages"].sum())], "wrapper": [json.dumps(wrapper)]})

    schema = "host string, pages long, wrapper string"
    own = source.mapInArrow(align_own, schema)
    for salts in SALTS:  # a host on every task merges in groups first
        own = own.withColumn("_salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts))).groupBy("host", "_salt").applyInPandas(merge, schema)
    return own.groupBy("host").applyInPandas(merge, schema)


def extract(pages: DataFrame, space: Workspace, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """pages without html, with text and n_chars."""
    spark = pages.sparkSession
    wrappers = space.table(infer(pages, url_col, html_col))

    def plans(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["host"], pa.array([json.dumps(plan_of(json.loads(w))) for w in batch["wrapper"].to_pylist()], pa.string())], names=["_ark_of", "_ark_plan"])

    planned = space.table(wrappers.select("host", "wrapper").mapInArrow(plans, "_ark_of string, _ark_plan string"))
    kept = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    rows = pages.select(*[pages[c] for c in kept], url_host(pages[url_col].cast("string")).alias("_ark_host"), pages[html_col].cast("binary").alias("_ark_html"))
    joined = rows.join(planned, F.col("_ark_host") == F.col("_ark_of"), "left").select(*kept, "_ark_html", "_ark_plan")
    schema = T.StructType([*[joined.schema[c] for c in kept], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for html, plan in zip(batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                if plan is not None and plan not in known:
                    if len(known) > HOSTS_HELD:
                        known.clear()
                    known[plan] = json.loads(plan)
                texts.append(main_text((html.as_py() or b"").decode("utf-8", "replace"), known.get(plan)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return joined.mapInArrow(run, schema)


def op5(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, Workspace(spark, "wrappers")).select("page_id", "url", "text", "n_chars")




#: Reads pages whose text is in one article element, as those of the tables are.
ORACLE = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article[^>]*>(.*?)(</article>|$)', 1), '(?i)<br\s*/?>', ' ', 'g') AS h FROM pages),
b AS (SELECT page_id, url, list_transform(regexp_split_to_array(h, '(?i)</?(p|h[1-6]|ul|ol|li|div|section|blockquote|pre)(\s[^>]*)?>'),
  lambda x: regexp_replace(x, '<[^>]*(>|$)', '', 'g')) AS parts FROM a),
c AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(replace(replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&copy;', chr(169)), '&middot;', chr(183)), '&amp;?', '&', 'g')) AS parts FROM b),
d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10) || chr(10)) AS text FROM c)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM d
"""
