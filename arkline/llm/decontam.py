"""Benchmark decontamination by a generalised suffix automaton.

One automaton holds every run of words of the benchmark items. Training words stream
through it; the state and the length of the longest match that ends at each word tell
which windows end there. A window is WINDOW consecutive words of an item, or the whole of
an item with fewer words; document words inside an occurrence of a window are hit.

Words whose neighbours never stand together in an item cannot lie in a window, so numpy
first cuts every text into the runs in which each pair of neighbours occurs in some item,
and only runs long enough for a window stream through the automaton.

Scale: documents are scanned in place, without a shuffle. The automaton is broadcast in
shards of at most SHARD_WORDS benchmark words (a longer item goes to several, with WINDOW - 1
words in common), at most SHARDS of them at once; a larger benchmark takes further passes over
the documents with what was found as columns, each from a written table. So what the driver
and a task hold has a bound, and no item is left out.

Defined results: a null or wordless text has no words and no hits; a null or wordless
item has no windows; repeated items or documents are matched each on their own; invalid
UTF-8 counts as word bytes. Result columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import set_aside
from .textkit import ALNUM, scan_words, scanned
from .workspace import Workspace

WINDOW = 10
SHARD_WORDS = 200_000
SHARDS = 4
_TABLE = ALNUM.tobytes()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class SuffixAutomaton:
    """Of several sequences of word numbers; state 0 is the empty match."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A copy of q for its matches up to p's length plus one."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def append(self, last: int, word: int) -> int:
        """The state of a sequence that ended in last, with one word more."""
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        """State and length of the longest match that ends with word."""
        while word not in self.next[state]:
            state = self.link[state]
            if state < 0:
                return 0, 0
            length = self.length[state]
        return self.next[state][word], length + 1


class Shard:
    """The automaton of some items, ready for documents."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        numbered = [(k, [self.ids.setdefault(w, len(self.ids)) for w in words]) for k, words in items]
        self.automaton = a = SuffixAutomaton()
        for _, seq in numbered:
            at = 0
            for w in seq:
                at = a.append(at, w)
        self.whole: dict[int, list] = {}  # state -> (length, item) of short items that end the match
        self.windowed: dict[int, set] = {}  # state of a full window -> items
        for k, seq in numbered:
            at = length = 0
            for w in seq:
                at, length = a.step(at, length, w)
                if length >= window:
                    self.windowed.setdefault(self._of_window(at), set()).add(k)
            if len(seq) < window:
                at = length = 0
                for w in seq:
                    at, length = a.step(at, length, w)
                self.whole.setdefault(at, []).append((length, k))
        self.shortest = min([window, *(len(seq) for _, seq in numbered)])
        self._arrays(numbered)

    def _of_window(self, state: int) -> int:
        """The state that holds the last ``window`` words of a longer match."""
        a = self.automaton
        while a.length[a.link[state]] >= self.window:
            state = a.link[state]
        return state

    def _arrays(self, numbered) -> None:
        vocabulary = b" ".join(self.ids)
        hashes = scan_words(np.frombuffer(vocabulary, np.uint8), np.array([0, len(vocabulary)]), ALNUM).hashes
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order.astype(np.int64)
        size = len(self.ids)
        pairs = {x * size + y for _, seq in numbered for x, y in zip(seq, seq[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)

    def runs(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words that may hold a window; first: where each text's words begin."""
        if not len(hashes) or not len(self.hashes):
            return
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        known = self.hashes[at] == hashes
        number = self.numbers[at]
        joined = known[:-1] & known[1:]
        if len(self.pairs):
            pair = number[:-1] * len(self.ids) + number[1:]
            where = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined &= self.pairs[where] == pair
        else:
            joined[:] = False
        inner = first[(first > 0) & (first < len(hashes))]
        joined[inner - 1] = False
        opens = known.copy()
        opens[1:] &= ~joined
        closes = known.copy()
        closes[:-1] &= ~joined
        begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        long = end - begin >= self.shortest
        yield from zip(begin[long].tolist(), end[long].tolist(), strict=True)

    def match(self, words: list[bytes]) -> Iterator[tuple[int, int, set]]:
        """(first word, past the last, items) of every occurrence of a window."""
        a, state, length = self.automaton, 0, 0
        for i, w in enumerate(words):
            number = self.ids.get(w)
            if number is None:
                state = length = 0
                continue
            state, length = a.step(state, length, number)
            if length >= self.window:
                yield i + 1 - self.window, i + 1, self.windowed.get(self._of_window(state), set())
            if self.whole:
                up = state
                while up > 0:
                    for size, item in self.whole.get(up, ()):
                        if size <= length:
                            yield i + 1 - size, i + 1, {item}
                    up = a.link[up]


def _shards(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> Iterator[Shard]:
    """Shards of at most SHARD_WORDS words; the driver holds one item and the shard that it builds."""
    items, size = [], 0
    rows = benchmark.select(benchmark[item_col].alias("k"), benchmark[text_col].cast("binary").alias("t")).where("t IS NOT NULL")
    for k, text in rows.toLocalIterator():
        words = words_of(bytes(text))
        step = max(SHARD_WORDS, 2 * window)
        for begin in range(0, max(1, len(words) - window + 1), step - window + 1):
            part = words[begin : begin + step]
            if items and size + len(part) > SHARD_WORDS:
                yield Shard(items, window)
                items, size = [], 0
            if part:
                items.append((k, part))
                size += len(part)
    if items:
        yield Shard(items, window)


def _matched(column: pa.Array, shards: list[Shard], known: list[tuple[list, set]]) -> Iterator[tuple[int, list, set, list]]:
    """Per text: words, hit ranges of words, items, and the ranges' byte offsets in the text.
    known: ranges and items found before."""
    for i, j, data, offsets, words in scanned(column, ALNUM):
        ranges: list[list] = [[list(r) for r in known[d][0]] for d in range(i, j)]
        items: list[set] = [known[d][1] for d in range(i, j)]
        for shard in shards:
            for begin, end in shard.runs(words.hashes, words.first):
                doc = int(np.searchsorted(words.first, begin, side="right")) - 1
                text = [data[words.starts[k] : words.ends[k]].tobytes().translate(_TABLE) for k in range(begin, end)]
                base = begin - int(words.first[doc])
                for x, y, found in shard.match(text):
                    own = ranges[doc]
                    if own and own[-1][1] >= x + base >= own[-1][0]:
                        own[-1][1] = max(own[-1][1], y + base)
                    else:
                        own.append([x + base, y + base])
                    items[doc] |= found
        for d in range(j - i):
            lo, hi = int(words.first[d]), int(words.first[d + 1])
            spans = [(int(words.starts[lo + x] - offsets[d]), int(words.ends[lo + y - 1] - offsets[d])) for x, y in _union(ranges[d])]
            yield hi - lo, _union(ranges[d]), items[d], spans


def _union(ranges: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x, y in sorted(map(tuple, ranges)):
        if out and x <= out[-1][1]:
            out[-1][1] = max(out[-1][1], y)
        else:
            out.append([x, y])
    return [tuple(r) for r in out]


_FOUND = "n_words long, n_hit long, longest long, items array<string>, spans array<struct<begin: long, end: long>>"
_RANGES = "_ark_ranges array<struct<begin: long, end: long>>"


def mark(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, space: Workspace | None = None) -> DataFrame:
    """docs with n_words, n_hit, longest (words of the longest hit range), items (sorted as
    strings) and spans (byte ranges of the text that hold the hit words). space: where the
    passes of a large benchmark keep their tables."""
    spark = docs.sparkSession
    added = T.StructType.fromDDL(f"{_FOUND}, {_RANGES}")
    found = docs.select(*[docs[c] for c in docs.columns if c not in added.names])
    shards = _shards(benchmark, item_col, item_text_col, window)
    group = list(islice(shards, SHARDS))
    while True:
        found = _pass(found, spark.sparkContext.broadcast(group), added, text_col)
        group = list(islice(shards, SHARDS))
        if not group:
            return found.drop("_ark_ranges")
        space = space or Workspace(spark, "decontam")
        found = space.table(found)


def _pass(docs: DataFrame, told, added: T.StructType, text_col: str) -> DataFrame:
    """docs with what these shards find, beside what a pass before has found."""
    kept = [c for c in docs.columns if c not in added.names]
    before = ("items", "_ark_ranges") if "_ark_ranges" in docs.columns else ()
    source = docs.select(*kept, docs[text_col].cast("binary").alias("_ark_text"), *(docs[c] for c in before))
    schema = T.StructType([*[source.schema[c] for c in kept], *added.fields])
    pairs = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        shards = told.value
        for batch in batches:
            known = [([], set()) for _ in range(batch.num_rows)]
            if before:
                known = [([(r["begin"], r["end"]) for r in ranges], set(items)) for items, ranges in zip(*(batch[c].to_pylist() for c in before), strict=True)]
            rows = list(_matched(batch["_ark_text"], shards, known))
            listed = lambda k, rows=rows: pa.array([[{"begin": x, "end": y} for x, y in r[k]] for r in rows], pairs)
            found = [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([sum(y - x for x, y in r[1]) for r in rows], pa.int64()),
                pa.array([max((y - x for x, y in r[1]), default=0) for r in rows], pa.int64()),
                pa.array([sorted(map(str, r[2])) for r in rows], pa.list_(pa.string())),
                listed(3),
                listed(1),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *found], names=schema.names)

    return source.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", max_coverage: float = 0.5, window: int = WINDOW) -> DataFrame:
    """docs whose hit words are at most max_coverage of their words, with every hit range cut
    out of the text; same columns. Texts without a hit stay as they are."""
    docs, own = set_aside(docs, ["n_words", "n_hit", "longest", "items", "spans", "_ark_ranges"])
    marked = mark(docs, benchmark, text_col, window=window)
    raw = F.col(text_col).cast("binary")
    # the parts between spans, joined again; positions count bytes from 1
    starts = F.concat(F.array(F.lit(0).cast("long")), F.col("spans.end"))
    stops = F.concat(F.col("spans.begin"), F.array(F.octet_length(raw).cast("long")))
    pieces = F.transform(F.arrays_zip(starts.alias("a"), stops.alias("b")), lambda p: F.substring(raw, (p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")).cast("string"))
    clean = F.when(F.size("spans") > 0, F.array_join(pieces, "")).otherwise(F.col(text_col))
    kept = marked.where(F.col("n_hit") <= max_coverage * F.col("n_words"))
    return own(kept.withColumn(text_col, clean))


def op3(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    marked = mark(docs, benchmark)
    return marked.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least({WINDOW}, len(w)) AS m FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM sized, LATERAL unnest(range(1, len(w) - m + 2)) AS u(i)),
docs AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
grams AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS g
  FROM docs, (SELECT DISTINCT m FROM sized) AS lengths, LATERAL unnest(range(1, len(w) - m + 2)) AS u(i)),
met AS (SELECT doc_id, i, m, item_id FROM grams JOIN windows USING (m, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n FROM met, LATERAL unnest(range(i, i + m)) AS u(p) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(k, ',' ORDER BY k COLLATE "C") AS ks FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM met) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ks, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
""".replace(' COLLATE "C"', "")
