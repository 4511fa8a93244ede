"""Exact n-gram Jaccard join in the metric space of shingle sets.

Distance is 1 - Jaccard similarity, a metric; sets within EPS = 1/5 link, and results are the
components of the links.

Pivots. A shingle that many sets have in their windows (below) is a crowded spot; the set
that is shared most there is a document pivot. Every set's distance to the pivots is
measured in place, on whole sets: pivots are few and broadcast with an index in which each
files its rarest 2/5 of shingles, one of which every set within 2 EPS holds.

Voronoi regions. A set within EPS of a pivot belongs to the region of the nearest one and
links with it; pivots that share such a set are one component. By the triangle inequality
whatever links with a set x of p's region lies in the window d(p, .) <= d(p, x) + EPS, so if all
sets there are of p's component, x is closed: no other link of x can matter, and it takes no
further part. The rest, boundary sets and those far from all pivots, are joined recursively:
their own crowded spots yield further pivots, level by level, until none are found or LEVELS
are done.

Distance 1. Most texts share no shingle, so no document pivot is nearer to them than any other and
a window of EPS around distance 1 holds everything. Sets that are far from all pivots are
therefore divided by single shingles, in a fixed order: linked sets have at least 4/5 of their
shingles in common, so below the first common one a set x has at most |x|/5, and x is copied
to the regions of its first |x|/5 + 1 shingles, its window, and to no others. The order is by
hash, but crowded shingles come last, the most crowded at the end; any order is exact.

Small regions. A region's most shared set leads it: all others are measured against the leader.
Sets of a region that are still in different components are compared in pairs, where their
sizes and places in the order leave room for the overlap. Pairs inside a component are never
made.

Comparisons. Exact copies are one set. Counts of shingles in BINS bins are at most as far
apart (in the sum of differences) as the sets, which drops most pairs; the others are
compared exactly on whole sets. Components come from alternating large and small stars.

Shingles and sets are 64-bit and 128-bit hashes.

Defined results: a null, empty or wordless text has no shingles, links with nothing and is
a component of its own; fewer than five words are one shingle; rows with equal ids count
each; a null id is no component's smallest unless all are null; invalid UTF-8 counts as word
bytes. Other columns are carried. Result columns replace input columns of the same name.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .filters import BitFilter
from .textkit import SPACED, mix, scan_spaced, scanned
from .workspace import Workspace

WORDS = 5
HOT = 64
LEVELS = 2
MAX_HOT = 200_000
PIVOTS = 256  # of each level
PIVOT_SIZE = 4096  # shingles of a pivot at most; with PIVOTS and LEVELS a bound of what is broadcast
SPLIT = 20_000
BINS = 128
FLUSH = 1 << 16
_U = np.uint64
_NO_LEAD = np.iinfo(np.int64).max
_KEY_BITS = 48
#: Odd multipliers that keep the words of a shingle in order.
_MIXERS = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | _U(1)


def shingle_sets(column: pa.Array):
    """The sorted distinct shingle hashes of each text."""
    for _, _, _, _, words in scanned(column, SPACED, scan_spaced):
        h, first = words.hashes, words.first.tolist()
        full = np.zeros(0, np.uint64)
        if len(h) >= WORDS:
            span = len(h) - WORDS + 1
            full = h[:span] * _MIXERS[0]
            for k in range(1, WORDS):
                full += h[k : k + span] * _MIXERS[k]
            full = mix(full)
        for a, b in pairwise(first):
            if b - a >= WORDS:
                full[a : b - WORDS + 1].sort()
        again = np.zeros(len(full), bool)
        np.equal(full[1:], full[:-1], out=again[1:])
        repeated = np.append(np.flatnonzero(again), len(h)).tolist()
        at = 0
        for a, b in pairwise(first):
            while repeated[at] <= a and repeated[at] < len(h):
                at += 1
            if b - a >= WORDS:
                own = full[a : b - WORDS + 1]
                if repeated[at] < b - WORDS + 1:
                    fresh = ~again[a : b - WORDS + 1]
                    fresh[0] = True
                    own = own[fresh]
                yield own
            elif b > a:
                yield mix(np.array([(h[a:b] * _MIXERS[: b - a]).sum() + _U(b - a)], np.uint64))
            else:
                yield full[:0]


def set_name(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s)


def _in_sorted(s: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(s), bool)
    return table[np.minimum(np.searchsorted(table, s), len(table) - 1)] == s


def shared(x: np.ndarray, y: np.ndarray) -> int:
    """How many values two sets have in common."""
    if len(x) > len(y):
        x, y = y, x
    return int(np.count_nonzero(_in_sorted(x, y)))


def window(s: np.ndarray) -> int:
    return len(s) // 5 + 1 if len(s) else 0


class Order:
    """The order of shingles: crowded ones (values, sorted; counts) last, the most crowded at the end."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        by_value = np.argsort(values)
        self.values, self.counts = values[by_value], counts[by_value]
        self.rank = np.empty(len(values), np.int64)
        self.rank[np.lexsort((self.values, self.counts))] = np.arange(len(values))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.values >> _U(44)).astype(np.int64)] = True

    def crowded(self, s: np.ndarray) -> np.ndarray:
        maybe = self.bits[(s >> _U(44)).view(np.int64)]
        maybe[maybe] = _in_sorted(s[maybe], self.values)
        return maybe

    def window(self, s: np.ndarray) -> np.ndarray:
        most = window(s)
        head = s[: 2 * most]
        head = head[~self.crowded(head)]
        if len(head) >= most:
            return head[:most]
        crowded = self.crowded(s)
        last = s[crowded]
        return np.concatenate([s[~crowded], last[np.argsort(self.rank[np.searchsorted(self.values, last)])]])[: window(s)]


class Pivots:
    """Document pivots. group: the component of each among the pivots; reach: sets nearer than
    that to it are all of its component."""

    def __init__(self, names: list[bytes], sets: list[np.ndarray]):
        self.names, self.sets = names, sets
        self.group, self.reach = np.arange(len(names)), np.zeros(len(names))
        every, held = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        filed = [s[np.argsort(held[np.searchsorted(every, s)], kind="stable")[: 2 * len(s) // 5 + 1]] for s in sets]
        flat = np.concatenate(filed) if filed else every
        owners = np.repeat(np.arange(len(sets)), [len(f) for f in filed])
        order = np.argsort(flat, kind="stable")
        self.values, first = np.unique(flat[order], return_index=True)
        self.first, self.owners = np.append(first, len(flat)), owners[order]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.values >> _U(42)).astype(np.int64)] = True

    def near(self, s: np.ndarray) -> list[tuple[int, int, int]]:
        """(pivot, size of the intersection, of the union) for the pivots within 2 EPS."""
        maybe = s[self.bits[(s >> _U(42)).view(np.int64)]]
        if not len(maybe):
            return []
        at = np.minimum(np.searchsorted(self.values, maybe), len(self.values) - 1)
        at = at[self.values[at] == maybe]
        if not len(at):
            return []
        out = []
        for k in np.unique(np.concatenate([self.owners[self.first[a] : self.first[a + 1]] for a in at])).tolist():
            p = self.sets[k]
            if 5 * min(len(p), len(s)) >= 3 * max(len(p), len(s)):
                common = shared(s, p)
                either = len(s) + len(p) - common
                if 5 * common >= 3 * either:
                    out.append((k, common, either))
        return out

    def closed(self, s: np.ndarray) -> bool:
        """Whether all that links with s is of its component."""
        return self.closes(self.near(s))

    def closes(self, near: list[tuple[int, int, int]]) -> bool:
        return any(100 * i >= 80 * u and 1 - i / u + 0.2 + 1e-9 < self.reach[k] for k, i, u in near)


class _Seen:
    """Names met in this task; forgets all when full, which costs repeated rows only."""

    def __init__(self, most: int = 50_000):
        self.names, self.most = set(), most

    def new(self, name: bytes) -> bool:
        if name in self.names:
            return False
        if len(self.names) >= self.most:
            self.names.clear()
        self.names.add(name)
        return True


def _signed(docs: DataFrame) -> DataFrame:
    schema = T.StructType([*docs.schema.fields[:-1], *T.StructType.fromDDL("_ark_n long, _ark_set binary").fields])

    def run(batches):
        for batch in batches:
            sizes, names = [], []
            for s in shingle_sets(batch.column(batch.num_columns - 1)):
                sizes.append(len(s))
                names.append(set_name(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(names, pa.binary())], names=schema.names)

    return docs.mapInArrow(run, schema)


# ---------------------------------------------------------------- document pivots


def _open_sets(batches, pivots: Pivots | None):
    """(key, name, set) of the sets that aren't closed, each once a task as far as remembered."""
    seen = _Seen()
    for batch in batches:
        keys = batch["_ark_key"].to_numpy()
        for key, s in zip(keys, shingle_sets(batch["_ark_text"]), strict=True):
            if len(s) and seen.new(name := set_name(s)) and not (pivots is not None and pivots.closed(s)):
                yield int(key), name, s


def _crowding(texts: DataFrame, order: Order, older: Order | None, pivots: Pivots | None) -> DataFrame:
    """pivot, n, lead: shingles that more than HOT sets have in their windows, and for those that
    became crowded with ``order`` the key of the set that is shared most there. With older (the
    order before) only windows that have changed since are counted, and what entered them."""
    sc = texts.sparkSession.sparkContext
    told = sc.broadcast((order, older, pivots))

    def rows(pivot, n, lead):
        return pa.RecordBatch.from_arrays([pa.array(pivot.view(np.int64)), pa.array(n), pa.array(lead)], names=["pivot", "n", "lead"])

    def run(batches):
        order, older, pivots = told.value
        leads = np.full(len(order.values), _NO_LEAD, np.int64)
        out, held = [], 0

        def flushed():
            flat = np.concatenate(out)
            return rows(flat, np.ones(len(flat), np.int64), np.full(len(flat), _NO_LEAD))

        for key, _, s in _open_sets(batches, pivots):
            if older is None:
                now = order.window(s)
            else:
                then = older.window(s)
                crowded = then[order.crowded(then)]
                newly = crowded[~older.crowded(crowded)]
                if not len(newly):
                    continue
                own = 32767 - 32767 * len(crowded) // len(then)
                at = np.searchsorted(order.values, newly)
                leads[at] = np.minimum(leads[at], (own << _KEY_BITS) | (key & ((1 << _KEY_BITS) - 1)))
                # a text that is mostly shared gets all its shingles counted at once, for each
                # level would only move its window on to further shared ones
                now = np.setdiff1d(s if 4 * len(newly) >= len(then) else order.window(s), then, assume_unique=True)
            out.append(now)
            held += len(now)
            if held > FLUSH:
                yield flushed()
                out, held = [], 0
        if out:
            yield flushed()
        found = np.flatnonzero(leads != _NO_LEAD)
        yield rows(order.values[found], np.zeros(len(found), np.int64), leads[found])

    counted = texts.mapInArrow(run, "pivot long, n long, lead long").groupBy("pivot").agg(F.sum("n").alias("n"), F.min("lead").alias("lead"))
    return counted.where((F.col("n") > HOT) | (F.col("lead") < _NO_LEAD))


def _fetched(texts: DataFrame, keys: list[int]) -> list[tuple[bytes, np.ndarray]]:
    """Names and sets of the texts with these keys, but for very long ones: PIVOTS x PIVOT_SIZE values."""

    def run(batches):
        for batch in batches:
            found = [(set_name(s), s.tobytes()) for s in shingle_sets(batch["_ark_text"]) if 0 < len(s) <= PIVOT_SIZE]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], names=["name", "values"])

    some = texts.where((F.col("_ark_key").bitwiseAND(F.lit((1 << _KEY_BITS) - 1))).isin(keys))
    got = some.mapInArrow(run, "name binary, values binary").groupBy("name").agg(F.first("values").alias("values")).limit(PIVOTS)
    return [(bytes(r[0]), np.frombuffer(bytes(r[1]), np.uint64)) for r in got.collect()]


def _measured(texts: DataFrame, pivots: Pivots) -> DataFrame:
    """set, pivot, home, linked, apart: the distances up to 2 EPS; home is the nearest pivot within EPS, or -1."""
    told = texts.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        pivots, out = told.value, []

        def flushed():
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int32(), pa.int32(), pa.bool_(), pa.float64()), strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["set", "pivot", "home", "linked", "apart"])

        for _, name, s in _open_sets(batches, None):
            near = pivots.near(s)
            if pivots.closes(near):
                continue
            inner = [(1 - i / u, k) for k, i, u in near if 100 * i >= 80 * u]
            home = min(inner)[1] if inner else -1
            out += [(name, k, home, 100 * i >= 80 * u, 1 - i / u) for k, i, u in near]
            if len(out) > 20_000:
                yield flushed()
                out = []
        if out:
            yield flushed()

    return texts.mapInArrow(run, "set binary, pivot int, home int, linked boolean, apart double")


def _settle(pivots: Pivots, near: DataFrame) -> None:
    """Groups and reaches of the pivots; at most PIVOTS x LEVELS of either and their pairs come to the driver."""
    group = pivots.group
    for a, b in near.where("linked AND pivot <> home").select("pivot", "home").distinct().collect():
        group[group == group[a]] = group[b]
    spark = near.sparkSession
    number = np.arange(len(group), dtype=np.int32)
    own = F.broadcast(spark.createDataFrame(pa.table({"_p": number, "_own": group.astype(np.int32)})))  # Arrow tables: lists of rows start Python workers of another kind, which stay
    other = F.broadcast(spark.createDataFrame(pa.table({"_h": number, "_other": group.astype(np.int32)})))
    met = near.join(own, F.col("pivot") == F.col("_p")).join(other, F.col("home") == F.col("_h"), "left")
    pivots.reach = np.full(len(group), 0.4 + 1e-6)
    for k, apart in met.where("_other IS NULL OR _other <> _own").groupBy("pivot").agg(F.min("apart")).collect():
        pivots.reach[k] = apart


def divided(texts: DataFrame, space: Workspace) -> tuple[Order, dict[int, int], Pivots | None, list[DataFrame]]:
    """The order, the shingles in more than SPLIT windows with their counts, the pivots, and links (a, b) with pivots."""
    spark = texts.sparkSession
    order, older, pivots, links, large = Order(np.zeros(0, np.uint64), np.zeros(0, np.int64)), None, None, [], {}
    for level in range(LEVELS + 1):
        counts = space.table(_crowding(texts, order, older, pivots))
        leads = counts.where(F.col("lead") < _NO_LEAD).select(F.col("lead").bitwiseAND(F.lit((1 << _KEY_BITS) - 1)).alias("k"))
        keys = [r[0] for r in leads.groupBy("k").count().orderBy(F.desc("count"), "k").limit(PIVOTS).collect()]
        known = set() if pivots is None else set(pivots.names)
        fresh = [x for x in _fetched(texts, keys) if x[0] not in known] if keys else []
        if fresh:
            before = pivots
            pivots = Pivots([*(before.names if before else []), *(x[0] for x in fresh)], [*(before.sets if before else []), *(x[1] for x in fresh)])
            if before:
                pivots.group[: len(before.names)], pivots.reach[: len(before.names)] = before.group, before.reach
            near = space.table(_measured(texts, pivots))
            _settle(pivots, near)
            names = F.broadcast(spark.createDataFrame(pa.table({"_p": np.arange(len(pivots.names), dtype=np.int32), "a": pa.array(pivots.names, pa.binary())})))
            links.append(near.where("linked").join(names, F.col("pivot") == F.col("_p")).select("a", F.col("set").alias("b")))
        room = MAX_HOT - len(order.values)
        got = counts.where(F.col("n") > HOT).orderBy(F.desc("n"), "pivot").limit(room).select("pivot", "n").toArrow() if room else None
        if got is None or not got.num_rows:
            break
        found, n = got["pivot"].to_numpy().view(np.uint64), got["n"].to_numpy()
        large |= {int(p): int(c) for p, c in zip(found[n > SPLIT], n[n > SPLIT], strict=True)}
        new = ~_in_sorted(found, order.values)
        if not new.any():
            break
        older, order = order, Order(np.concatenate([order.values, found[new]]), np.concatenate([order.counts, n[new]]))
    return order, large, pivots, links


# ---------------------------------------------------------------- regions of shingles


def _regions(texts: DataFrame, order: Order, large: dict[int, int], pivots: Pivots | None) -> DataFrame:
    """pivot, leader, set, size, place (of the pivot in the set's order): every set of a region with several."""
    told = texts.sparkSession.sparkContext.broadcast((order, {p: -(-c // SPLIT) for p, c in large.items()}, pivots))
    names = ["pivot", "part", "s0", "s1", "size", "place"]

    def emit(batches):
        order, parts, pivots = told.value
        out, held = [], 0

        def flushed():
            times = [len(own) for own, _, _, _ in out]
            flat = np.concatenate([own for own, _, _, _ in out])
            sets = np.repeat(np.frombuffer(b"".join(name for _, _, name, _ in out), np.int64).reshape(-1, 2), times, axis=0)
            columns = (flat.view(np.int64), np.concatenate([part for _, part, _, _ in out]), np.ascontiguousarray(sets[:, 0]), np.ascontiguousarray(sets[:, 1]), np.repeat(np.array([n for _, _, _, n in out], np.int32), times), np.concatenate([np.arange(t, dtype=np.int32) for t in times]))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        for _, name, s in _open_sets(batches, pivots):
            own = order.window(s)
            part = np.zeros(len(own), np.int32)
            if parts:
                salt = int.from_bytes(name[:4], "little")
                part[:] = [salt % parts.get(int(p), 1) for p in own]
            out.append((own, part, name, len(s)))
            held += len(own)
            if held > FLUSH:
                yield flushed()
                out, held = [], 0
        if out:
            yield flushed()

    rows = texts.mapInArrow(emit, "pivot long, part int, s0 long, s1 long, size int, place int")
    rows = rows.repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.col("place") / F.col("size"), "s0", "s1")

    def lead(batches):
        parted = np.array(sorted(told.value[1]), np.uint64)
        held = None  # (pivot, part, leader, last set, the leader's row while it is alone)

        def regions(pivot, leader, sets, size, place):
            name = lambda x: pa.array([bytes(r) for r in x.view("V16").ravel()], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(pivot), name(leader), name(sets), pa.array(size), pa.array(place)], names=_REGION)

        for batch in batches:
            pivot, part, size, place = (batch[c].to_numpy() for c in ("pivot", "part", "size", "place"))
            if not len(pivot):
                continue
            sets = np.stack([batch["s0"].to_numpy(), batch["s1"].to_numpy()], axis=1)
            opens, copy = np.ones(len(pivot), bool), np.zeros(len(pivot), bool)
            opens[1:] = (pivot[1:] != pivot[:-1]) | (part[1:] != part[:-1])
            copy[1:] = ~opens[1:] & (sets[1:] == sets[:-1]).all(1)
            if held is not None and held[0] == pivot[0] and held[1] == part[0]:
                opens[0], copy[0] = False, (held[3] == sets[0]).all()
            pivot, part, size, place, sets, opens = (x[~copy] for x in (pivot, part, size, place, sets, opens))
            if not len(pivot):
                continue
            several = ~opens
            several[:-1] |= ~opens[1:]
            if len(parted):  # a divided region's sets meet those of its other parts later
                several |= _in_sorted(pivot.view(np.uint64), parted)
            before = None
            if not opens[0]:
                before = held[2]
                if held[4] is not None:
                    yield held[4]
            starts = np.maximum.accumulate(np.where(opens, np.arange(len(pivot)), -1))
            leaders = sets[np.maximum(starts, 0)]
            if before is not None:
                leaders[starts < 0] = before
            yield regions(pivot[several], leaders[several], sets[several], size[several], place[several])
            last = starts[-1]
            alone = regions(pivot[-1:], sets[-1:], sets[-1:], size[-1:], place[-1:]) if last == len(pivot) - 1 and not several[-1] else None
            held = (pivot[-1], part[-1], leaders[-1].copy(), sets[-1].copy(), alone)

    return rows.mapInArrow(lead, "pivot long, leader binary, set binary, size int, place int")


_REGION = ["pivot", "leader", "set", "size", "place"]


def _described(texts: DataFrame, wanted: DataFrame, what: str, space: Workspace) -> DataFrame:
    """set and ``what`` (shingles or bins) of the wanted sets. The filter keeps most others from
    moving; what it lets through besides finds no partner in the joins."""
    told = texts.sparkSession.sparkContext.broadcast(BitFilter(wanted, "set"))

    def run(batches):
        bits, seen = told.value, _Seen()
        names, values, size = [], [], 0
        for batch in batches:
            for s in shingle_sets(batch["_ark_text"]):
                if not len(s) or (name := set_name(s)) not in bits or not seen.new(name):
                    continue
                names.append(name)
                values.append(s.tobytes() if what == "shingles" else _bins(s))
                size += len(values[-1])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (names, values)], names=["set", what])
                    names, values, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (names, values)], names=["set", what])

    found = texts.mapInArrow(run, f"set binary, {what} binary")
    return space.table(found.dropDuplicates(["set"]))


def _bins(s: np.ndarray) -> bytes:
    """The size as 8 bytes, then how many shingles each bin has, 65535 at most."""
    counts = np.bincount((s >> _U(20)).astype(np.int64) & (BINS - 1), minlength=BINS)
    return np.int64(len(s)).tobytes() + np.minimum(counts, 65535).astype(np.uint16).tobytes()


def _compared(pairs: DataFrame, texts: DataFrame, bins: DataFrame, space: Workspace) -> DataFrame:
    """Of pairs (a, b) those that link. bins: those of all sets in pairs."""

    def both(p, table, column):
        side = lambda name: table.select(F.col("set").alias(f"_{name}"), F.col(column).alias(f"{column}_{name}"))
        return p.join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b")).select("a", "b", f"{column}_a", f"{column}_b")

    def near(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                x, y = (np.frombuffer(b"".join(part[c].to_pylist()), np.uint8).reshape(-1, 8 + 2 * BINS) for c in ("bins_a", "bins_b"))
                size = sum(np.ascontiguousarray(v[:, :8]).view(np.int64)[:, 0] for v in (x, y))
                x, y = (np.ascontiguousarray(v[:, 8:]).view(np.uint16).astype(np.int32) for v in (x, y))
                # |x ^ y| is at least the bins' distance, and at most (|x| + |y|) / 9 where x and y link
                yield pa.RecordBatch.from_arrays([part["a"], part["b"]], names=["a", "b"]).filter(pa.array(9 * np.abs(x - y).sum(1) <= size))

    def equal(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch["shingles_a"], batch["shingles_b"], strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = shared(x, y)
                ok.append(100 * common >= 80 * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    close = space.table(both(pairs, bins, "bins").mapInArrow(near, "a binary, b binary"))
    sets = _described(texts, close.select(F.col("a").alias("set")).union(close.select(F.col("b").alias("set"))), "shingles", space)
    linked = space.table(both(close, sets, "shingles").mapInArrow(equal, "a binary, b binary"))
    space.drop(sets)
    return linked


def components(links: DataFrame, space: Workspace) -> DataFrame:
    """set and root (the smallest of its component) of every set with a link (a, b)."""
    edges = space.table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = space.table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        # large star: neighbours above u move to the smallest around u
        stars = both.where("v > u").join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = space.table(stars.where("u <> v").distinct())
        # small star: u and its neighbours below it move to the smallest of these
        least = space.table(edges.groupBy("u").agg(F.min("v").alias("m")))
        down = edges.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
        edges = space.table(down.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("set"), F.col("v").alias("root"))
        state = now


def grouped(docs: DataFrame, space: Workspace, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(docs without text, with _ark_id, n_shingles and _ark_set; a row for each _ark_set with its
    smallest id, first, and its component's root)."""
    rest = [docs[c] for c in docs.columns if c not in (text_col, "n_shingles", "component_id")]
    signed = space.table(_signed(docs.select(*rest, docs[id_col].alias("_ark_id"), docs[text_col].cast("binary").alias("_ark_text"))).withColumnRenamed("_ark_n", "n_shingles"))
    texts = docs.select(F.xxhash64(docs[id_col]).alias("_ark_key"), docs[text_col].cast("binary").alias("_ark_text")).where("_ark_text IS NOT NULL")
    roots = set_components(texts, space)
    firsts = signed.where("_ark_set IS NOT NULL").groupBy("_ark_set").agg(F.min("_ark_id").alias("first"))
    return signed, space.table(firsts.join(roots, F.col("_ark_set") == F.col("set"), "left").select("_ark_set", "first", F.coalesce("root", "_ark_set").alias("root")))


def join(docs: DataFrame, space: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_shingles and component_id, the smallest id among the texts it is linked to."""
    signed, rooted = grouped(docs, space, id_col, text_col)
    least = rooted.groupBy(F.col("root").alias("_root")).agg(F.min("first").alias("_component"))
    named = space.table(rooted.join(least, F.col("root") == F.col("_root")).select(F.col("_ark_set").alias("_named"), "_component"))
    out = signed.join(named, F.col("_ark_set") == F.col("_named"), "left")
    return out.select(*[c for c in docs.columns if c not in (text_col, "n_shingles", "component_id")], "n_shingles", F.coalesce("_component", "_ark_id").alias("component_id"))


def one_of_each(docs: DataFrame, space: Workspace, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: of its texts the one with the smallest id (a null
    id counts last). Texts without a word all stay."""
    _, rooted = grouped(docs.select(id_col, text_col), space, id_col, text_col)
    best = rooted.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("n"), "first", "_ark_set")).alias("k"))
    keep = space.table(best.select(F.col("k.first").alias("_keep_id"), F.col("k._ark_set").alias("_keep_set")))
    named = _signed(docs.select(*[docs[c] for c in docs.columns], docs[text_col].cast("binary").alias("_ark_text"))).drop("_ark_n")
    kept = named.where("_ark_set IS NOT NULL").join(keep, F.col(id_col).eqNullSafe(F.col("_keep_id")) & (F.col("_ark_set") == F.col("_keep_set")), "left_semi")
    return kept.dropDuplicates([id_col, "_ark_set"]).unionByName(named.where("_ark_set IS NULL")).select(*docs.columns)


def set_components(texts: DataFrame, space: Workspace) -> DataFrame:
    """set and root of every shingle set that has a link; texts has _ark_key, a number for the
    text that need not be its own, and _ark_text."""
    order, large, pivots, links = divided(texts, space)
    regions = space.table(_regions(texts, order, large, pivots))
    met = regions.where("leader <> set").select("leader", "set")
    if large:  # leaders of a divided region meet its first
        tops = regions.groupBy("pivot").agg(F.min("leader").alias("top"), F.max("leader").alias("end")).where("top <> end")
        parts = regions.where("set = leader").join(tops, "pivot").where("leader <> top")
        met = met.union(parts.select(F.col("top").alias("leader"), F.col("leader").alias("set")))
    met = space.table(met.distinct())
    bins = _described(texts, met.select("set").union(met.select(F.col("leader").alias("set"))), "bins", space)
    for more in links[1:]:
        links[0] = links[0].union(more)
    first = _compared(met.select(F.col("leader").alias("a"), F.col("set").alias("b")), texts, bins, space)
    known = first.union(links[0]) if links else first
    roots = components(known, space)
    rows = _open_regions(regions, roots, space)
    space.drop(regions)
    pairs = _open_pairs(rows, space)
    space.drop(rows)
    if pairs.isEmpty():
        return roots
    more = _compared(pairs, texts, bins, space)
    return roots if more.isEmpty() else components(known.union(more), space)


def _open_regions(regions: DataFrame, roots: DataFrame, space: Workspace) -> DataFrame:
    """Rows, with their roots, of the regions that hold several components."""
    named = regions.join(roots.select(F.col("set").alias("_s"), F.col("root").alias("_r")), F.col("set") == F.col("_s"), "left").select("pivot", "set", "size", "place", F.coalesce("_r", "set").alias("root"))
    named = space.table(named)
    open_ = named.groupBy("pivot").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi").select(F.col("pivot").alias("_open"))
    rows = space.table(named.join(open_, F.col("pivot") == F.col("_open"), "left_semi"))
    space.drop(named)
    return rows


def _fits(size_x, place_x, size_y, place_y):
    """Whether two sets may link whose first common shingle is the region's pivot: by their sizes,
    by what either has left from there on, and by what both have before it, which they don't share."""
    rest, before = F.least(size_x - place_x, size_y - place_y), place_x + place_y
    return (5 * F.least(size_x, size_y) >= 4 * F.greatest(size_x, size_y)) & (9 * rest >= 4 * (size_x + size_y)) & (9 * before <= size_x + size_y)


def _open_pairs(rows: DataFrame, space: Workspace) -> DataFrame:
    """Pairs of a region's sets in different components that may link."""
    x = rows.select("pivot", *[F.col(c).alias(f"{c}_x") for c in ("set", "size", "place", "root")])
    y = rows.select(F.col("pivot").alias("pivot_y"), *[F.col(c).alias(f"{c}_y") for c in ("set", "size", "place", "root")])
    fits = _fits(F.col("size_x"), F.col("place_x"), F.col("size_y"), F.col("place_y"))
    pairs = x.join(y, (F.col("pivot") == F.col("pivot_y")) & (F.col("set_x") < F.col("set_y")) & (F.col("root_x") != F.col("root_y")) & fits)
    return space.table(pairs.select(F.col("set_x").alias("a"), F.col("set_y").alias("b")).distinct())


def op4(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join(docs, Workspace(spark, "jaccard")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
rare AS (SELECT doc_id, n, g, row_number() OVER (PARTITION BY doc_id ORDER BY md5(g), g) AS p FROM grams),
pre AS (SELECT doc_id, n, g FROM rare WHERE p <= n // 5 + 1),
pairs AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny FROM pre a JOIN pre b ON a.g = b.g AND a.doc_id < b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
common AS (SELECT x, y, nx, ny, len(list_intersect(a.s, b.s)) AS i FROM pairs JOIN sets a ON a.doc_id = x JOIN sets b ON b.doc_id = y),
links AS (SELECT x, y FROM common WHERE 100 * i >= 80 * (nx + ny - i)),
sym AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, sym.y FROM reach JOIN sym ON sym.x = reach.r)
SELECT doc_id, len(s)::BIGINT AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = sets.doc_id) AS component_id FROM sets
"""
