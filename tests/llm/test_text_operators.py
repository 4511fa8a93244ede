"""Each operator against a plain version of its definition, on small hostile inputs."""

import base64
import hashlib
import io
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arkline.llm import decontam, jaccard, secrets, textkit, urlrules, warc
from arkline.llm.workspace import Workspace

TEXTS = [None, "", " ", "one", "One two", "a b c d e", "A  b\tc\nd e", "a b c d e f", "é É ß 日本語 x", "x" * 5000, "word " * 3000, "\x00\x01 tab\x0bend", "ÀB a\u00a0b"]


def _docs(spark, texts, **extra):
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans string, n_shingles int")


# ---------------------------------------------------------------- words


@pytest.mark.parametrize("table, pattern", [(textkit.SPACED, rb"[^\x20\x09-\x0d]+"), (textkit.ALNUM, rb"[0-9a-z\x80-\xff]+")])
def test_words(table, pattern, monkeypatch):
    monkeypatch.setattr(textkit, "SEGMENT", 64)
    raw = [(t or "").encode() for t in TEXTS] + [b"", b"\xff\xfe broken", b"q" * 1000]
    lowered = [re.sub(rb"[A-Z]", lambda m: m[0].lower(), r) for r in raw]
    offsets = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    words = textkit.scan_words(data, offsets, table)
    got = [[data[words.starts[k] : words.ends[k]].tobytes().lower() for k in range(words.first[i], words.first[i + 1])] for i in range(len(raw))]
    assert got == [[w.lower() for w in re.findall(pattern, r)] for r in lowered]
    by_word = defaultdict(set)
    for text, i in zip(got, range(len(raw)), strict=True):
        for k, w in enumerate(text):
            by_word[w].add(int(words.hashes[words.first[i] + k]))
    assert all(len(h) == 1 for h in by_word.values()) and len({min(h) for h in by_word.values()}) == len(by_word)


# ---------------------------------------------------------------- 1 WARC


def test_warc_round_trip(spark):
    space = Workspace(spark, "test-warc")
    rows = [(1, "http://a/ x", "same"), (2, "http://b", "same"), (3, None, None), (4, "http://c\r\nX: y", ""), (5, "http://d", "é" * 70_000), (5, "http://d", "é" * 70_000), (None, "u", "same"), (None, "u", "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert warc.write_warc(df, space.subdir("a"), "page_id", "url", "html", space, max_bytes=300) == 8
    got = warc.read_warc(spark, space.subdir("a")).collect()
    assert all(r.digest_ok for r in got)
    found = sorted((r.record_id, r.warc_type, r.refers_to or "", r.payload_length, bytes(r.payload)) for r in got)
    whole = "é".encode() * 70_000
    assert found == sorted([("1", "revisit", "2", 4, b""), ("2", "response", "", 4, b"same"), ("3", "revisit", "4", 0, b""), ("4", "response", "", 0, b""), ("5", "response", "", 140_000, whole), ("5", "response", "", 140_000, whole), ("", "revisit", "2", 4, b""), ("", "response", "", 5, b"alone")])
    assert {r.target_uri for r in got if r.record_id == "4"} == {"http://c%0D%0AX:%20y"}
    space.release()


def test_warc_small_payloads_and_empty_table(spark):
    space = Workspace(spark, "test-warc")
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    warc.write_warc(df, space.subdir("a"), "page_id", "url", "html", space, min_bytes=3)
    assert {r.warc_type for r in warc.read_warc(spark, space.subdir("a")).collect()} == {"response"}
    assert warc.write_warc(df.limit(0), space.subdir("b"), "page_id", "url", "html", space) == 0
    assert warc.read_warc(spark, space.subdir("b")).count() == 0
    space.release()


@pytest.mark.parametrize("harm", ["cut", "flip", "length"])
def test_warc_damage(harm):
    good = warc.encode_record("1", "u", b"payload" * 100, None, "d", 6)
    if harm == "cut":
        bad = good[:-9]
    elif harm == "flip":
        bad = good[:60] + bytes([good[60] ^ 255]) + good[61:]
    else:
        plain = zlib.decompress(good, 31)
        bad = zlib.compress(re.sub(rb"\r\nContent-Length: \d+\r\n\r\nHTTP", b"\r\nContent-Length: 50\r\n\r\nHTTP", plain), wbits=31)
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(bad)))
    one = next(warc.read_records(io.BytesIO(good + good)))
    assert one.headers["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"payload" * 100).digest()).decode()


def test_warc_wrong_digest_is_seen():
    plain = zlib.decompress(warc.encode_record("1", "u", b"payload", None, "d", 6), 31)
    (record,) = warc.read_records(io.BytesIO(zlib.compress(plain.replace(b"payload\r\n", b"pAyload\r\n"), wbits=31)))
    assert not record.digest_ok


def _plain_record(head: bytes, block: bytes) -> bytes:
    return b"WARC/1.1\r\n" + head + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def test_files_without_compression():
    records = [(b"WARC-Type: warcinfo\r\n", b"info"), (b"WARC-Type: response\r\nContent-Type: application/http\r\n", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n12345"), (b"WARC-Type: response\r\nContent-Type: application/http\r\n", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\n" + b"z" * 200_000), (b"WARC-Type: resource\r\n", b"")]
    raw = b"".join(_plain_record(*r) for r in records)
    got = list(warc.read_records(io.BytesIO(raw)))
    assert [(r.payload_length, len(r.payload)) for r in got] == [(4, 4), (5, 5), (200_000, 200_000), (0, 0)]
    assert [raw[r.offset : r.offset + 5] for r in got] == [b"WARC/"] * 4
    packed = b"".join(zlib.compress(_plain_record(*r), wbits=31) for r in records)
    assert [(r.payload, r.payload_length) for r in warc.read_records(io.BytesIO(packed))] == [(r.payload, r.payload_length) for r in got]
    assert list(warc.read_records(io.BytesIO(b""))) == []
    for bad in (raw[:-3], raw[:300], raw.replace(b"12345", b"1234")):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))


def test_headers_and_members_have_a_bound():
    head = b"WARC-Type: response\r\nContent-Type: application/http\r\n"
    for bad in (zlib.compress(_plain_record(head, b"x" * (3 << 20)), wbits=31), zlib.compress(_plain_record(b"WARC-Type: resource\r\n", b"x") + b"y" * (64 << 20), wbits=31)):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))


def test_clashing_names_in_an_archive(spark):
    space = Workspace(spark, "test-warc")
    df = spark.createDataFrame([(1, "http://a", "x", "k", "p"), (2, "http://b", "x", "k", "p")], "page_id long, url string, html string, key string, payload string")
    assert warc.write_warc(df, space.subdir("a"), "page_id", "url", "html", space) == 2
    assert sorted((r.record_id, r.warc_type) for r in warc.read_warc(spark, space.subdir("a")).collect()) == [("1", "revisit"), ("2", "response")]
    space.release()


# ---------------------------------------------------------------- 3 decontamination


def _plain_windows(text, items, window):
    words = decontam.words_of((text or "").encode())
    hit, found = set(), set()
    for k, item in items:
        own = decontam.words_of((item or "").encode())
        size = min(window, len(own))
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(k)
    return len(words), len(hit), sorted(map(str, found))


def test_decontamination_equals_brute_force(spark, monkeypatch):
    """In several passes, with items that go to several shards."""
    monkeypatch.setattr(decontam, "SHARD_WORDS", 7)
    monkeypatch.setattr(decontam, "SHARDS", 4)
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choices("ab c d é".split(), k=rng.randint(0, 40))) for _ in range(150)]
    items = [(i, " ".join(rng.choices("ab c d é".split(), k=rng.randint(0, 9)))) for i in range(12)] + [(40, " ".join(rng.choices("ab c d é".split(), k=30))), (50, None), (51, "A b C"), (52, "a B c"), (53, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    marked = decontam.mark(_docs(spark, texts), benchmark, window=4)
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in marked.collect()}
    assert got == {i: _plain_windows(t, items, 4) for i, t in enumerate(texts)}


def test_decontamination_cuts_only_hits(spark):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    texts = ["Keep this, Alpha  beta-gamma délta delta!", "é x, alpha beta Gamma; delta. ü y and more words here", "alpha beta gamma delta", None, ""]
    got = {r.doc_id: r.text for r in decontam.decontaminate(_docs(spark, texts), benchmark, max_coverage=0.6).collect()}
    assert got == {0: texts[0], 1: "é x, . ü y and more words here", 3: None, 4: ""}
    assert decontam.mark(_docs(spark, texts), benchmark.limit(0)).where("n_hit > 0").count() == 0
    assert decontam.mark(_docs(spark, texts).limit(0), benchmark).count() == 0


def test_cuts_leave_invalid_bytes_alone(spark):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    raw = [b"x\xff y and alpha beta gamma delta, then \xc3 more words of its own here", b"\xfe\xfe", b"alpha beta gamma delta \xff"]
    docs = spark.createDataFrame(list(enumerate(raw)), "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"))
    got = decontam.decontaminate(docs, benchmark, max_coverage=0.5)
    assert {r.doc_id: bytes(r.b) for r in got.select("doc_id", F.col("text").cast("binary").alias("b")).collect()} == {0: b"x\xff y and , then \xc3 more words of its own here", 1: b"\xfe\xfe"}


# ---------------------------------------------------------------- 4 near copies


def _plain_components(texts):
    sets = {}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def _near_copies(rng, n):
    vocabulary = [f"w{k}" for k in range(60)]
    passage = rng.choices(vocabulary, k=30)
    texts = []
    for _ in range(n):
        base = rng.choices(vocabulary, k=rng.randint(3, 90)) + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    return texts


def test_shingle_sets_take_words_by_eights(monkeypatch):
    """The sets need no hash of every byte; words of any length, beside text borders too, are told apart."""

    def refused(*_):
        raise AssertionError("every byte was hashed")

    monkeypatch.setattr(textkit, "SEGMENT", 64)
    rng = random.Random(5)
    pool = [bytes(rng.choices(b"aAz@[`{\x00\x08\x0e\xff", k=k)) for k in (1, 1, 2, 3, 7, 8, 9, 15, 16, 17, 31, 63, 64, 65, 72, 73, 200)]
    pool += [w + b"\x00" for w in pool] + [w[:-1] + b"Q" for w in pool]
    raw = [rng.choice([b"", b" "]) + b"".join(w + rng.choice([b" ", b"\t", b"\x0b\r "]) for w in rng.choices(pool, k=k)) + rng.choice(pool) for k in (0, 1, 3, 4, 5, 9, 40, 200) for _ in range(4)] + [b"", b"", b" \n"]
    rng.shuffle(raw)
    offsets, data = np.cumsum([0, *map(len, raw)]), np.frombuffer(b"".join(raw), np.uint8)
    plain, quick = textkit.scan_words(data, offsets, textkit.SPACED), textkit.scan_words(data, offsets, textkit.SPACED, textkit.scan_spaced)
    assert all((getattr(plain, c) == getattr(quick, c)).all() for c in ("starts", "ends", "first"))
    words = [data[a:b].tobytes().lower() for a, b in zip(quick.starts, quick.ends, strict=True)]
    assert len(set(words)) == len(set(quick.hashes.tolist())) == len(set(zip(words, quick.hashes.tolist(), strict=True)))

    monkeypatch.setattr(textkit, "span_hashes", refused)
    texts = [re.findall(rb"[^\x20\x09-\x0d]+", r.lower()) for r in raw]
    want = [{tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set() for w in texts]
    got = [s.copy() for s in jaccard.shingle_sets(pa.array(raw, pa.binary()))]
    assert [len(s) for s in got] == [len(w) for w in want] and all((s[1:] > s[:-1]).all() for s in got)
    assert all(jaccard.shared(got[i], got[j]) == len(want[i] & want[j]) for i in range(len(raw)) for j in range(i))


def test_crowded_shingles_are_found():
    rng = np.random.default_rng(6)
    values = rng.integers(0, 1 << 63, 5000, np.uint64) * np.uint64(2)
    order = jaccard.Order(values[:3000], np.arange(3000))
    s = np.sort(np.concatenate([values[2900:3100], values[2900:2950] + np.uint64(1)]))
    assert (order.crowded(s) == np.isin(s, values[:3000])).all() and not order.crowded(s[:0]).any()
    first = s[~np.isin(s, values[:3000])]
    assert (order.window(s) == first[: jaccard.window(s)]).all()
    last = values[2900:3000]  # counts ascend
    assert (order.window(np.sort(last)) == last[: jaccard.window(last)]).all()


@pytest.mark.parametrize("hot, split", [(64, 20_000), (2, 3), (0, 1)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, hot, split):
    """Also with nearly every shingle last in the order, and with every hot region divided."""
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "SPLIT", split)
    texts = TEXTS + TEXTS[3:6] + _near_copies(random.Random(hot), 60)
    space = Workspace(spark, "test-jaccard")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(_docs(spark, texts), space).collect()}
    assert got == _plain_components(texts)
    space.release()


def test_pivots_close_a_hot_group(spark, monkeypatch):
    """Copies of one text with a word changed, some further off, and texts that share a passage only."""
    monkeypatch.setattr(jaccard, "HOT", 8)
    rng = random.Random(4)
    base = [f"b{k}" for k in range(80)]
    texts = []
    for i in range(90):
        own = list(base)
        for _ in range(i % 4):
            own[rng.randrange(80)] = f"n{i}"
        texts.append(" ".join(own))
    texts += [" ".join([*base[:30], *(f"u{i}x{k}" for k in range(60))]) for i in range(30)]
    docs = _docs(spark, texts)
    space = Workspace(spark, "test-jaccard")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, space).collect()}
    assert got == _plain_components(texts)
    keyed = docs.select(F.xxhash64("doc_id").alias("_ark_key"), F.col("text").cast("binary").alias("_ark_text"))
    _, _, pivots, links = jaccard.divided(keyed, space)
    sets = list(jaccard.shingle_sets(pa.array(texts)))
    for s in sets:  # the index misses no pivot within 2 EPS
        want = {k for k, p in enumerate(pivots.sets) if 5 * jaccard.shared(s, p) >= 3 * (len(s) + len(p) - jaccard.shared(s, p))}
        assert {k for k, _, _ in pivots.near(s)} == want
    assert links and sum(pivots.closed(s) for s in sets) > 20
    space.release()


def test_join_and_ledger_make_no_tables_from_python_rows(spark, monkeypatch):
    """Those start Python workers of another kind on every executor, which stay."""
    monkeypatch.setattr(jaccard, "HOT", 8)
    texts = [" ".join([*(f"b{k}" for k in range(80)), *(f"n{i}" for _ in range(i % 4))]) for i in range(30)]
    docs = _docs(spark, texts)

    def refused(*_, **__):
        raise AssertionError("rows of Python were dealt to workers")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    space = Workspace(spark, "test-rows")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(docs, space).collect()}
    assert got == _plain_components(texts)
    ledger = secrets.Ledger(spark, space.subdir("ledger"))
    assert ledger.rows().isEmpty() and [c for c, _ in ledger.rows().dtypes] == ["blob", "rules", "findings"]
    assert secrets.redact(docs, ledger, space).count() == 30
    space.release()


def test_jaccard_join_of_odd_texts(spark):
    space = Workspace(spark, "test-jaccard")
    raw = [b"a \xff c d e f", b"a \xff c d e f", b"a \xfe c d e f", ("w " * 300_000).encode(), ("w " * 300_001).encode(), None, b""]
    docs = spark.createDataFrame([(i % 6, x) for i, x in enumerate(raw)], "doc_id long, raw binary").select("doc_id", F.col("raw").cast("string").alias("text"), F.lit(1).alias("component_id"), F.lit("k").alias("set"))
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join(docs, space).collect())
    assert got == [(0, 0, 0), (0, 2, 0), (1, 2, 0), (2, 2, 2), (3, 1, 3), (4, 1, 3), (5, 0, 5)]
    space.release()


def test_one_of_each_component_stays(spark):
    space = Workspace(spark, "test-jaccard")
    texts = ["a b c d e f g h i j k l", "x y", "A b c d e f g h i j k l", "", None, "x  y", "z"]
    docs = _docs(spark, texts).unionAll(_docs(spark, texts[:1]))
    kept = jaccard.one_of_each(docs, space)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 3, 4, 6]
    assert jaccard.join(docs.limit(0), space).count() == 0
    space.release()


def test_components_of_chains_and_stars(spark):
    space = Workspace(spark, "test-cc")
    links = [(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"z", bytes([100 + i])) for i in range(20)]
    random.Random(1).shuffle(links)
    got = {bytes(r.set): bytes(r.root) for r in jaccard.components(spark.createDataFrame(links, "a binary, b binary"), space).collect()}
    assert {v for k, v in got.items() if k <= bytes([40])} == {b"\0"}
    assert {v for k, v in got.items() if k >= bytes([100])} == {min(b"z", bytes([100]))}
    space.release()


# ---------------------------------------------------------------- 6 secrets


def test_secrets_by_definition(spark):
    space = Workspace(spark, "test-secrets")
    key, run = "AKIA" + "Z9" * 8, "0123456789abcdef" * 2
    texts = [f"é PassWord = 'abcdefgh' {key}", f"token:short api_key:{run} x", f"apikey=\"{run}g\"", "AKIAAKIA12", "secret : abc.def=12", None, "", f"{run}f" * 2, f"é PassWord = 'abcdefgh' {key}", "-----BEGIN RSA PRIVATE KEY-----"]
    ledger = secrets.Ledger(spark, space.subdir("ledger"))
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.findings] for r in secrets.scan(_docs(spark, texts), ledger, space).collect()}
    assert found[0] == found[8] == [("assign", 2, 22), ("access", 24, 44)]
    assert found[1] == [("assign", 12, 52), ("hex", 20, 52)]
    assert found[2] == [("assign", 0, 41), ("hex", 8, 40)]
    assert found[3] == found[5] == found[6] == [] and found[4] == [("assign", 0, 19)]
    assert found[7] == [("hex", 0, 66)] and found[9] == [("pem", 0, 31)]
    space.release()


def _pairs(ledger):
    return sorted((bytes(r.blob), x) for r in ledger.rows().collect() for x in r.rules)


def test_ledger_scans_only_unseen_pairs(spark, monkeypatch):
    """Two versions of documents and two of the rules; findings are those of a scan from nothing."""
    space = Workspace(spark, "test-secrets")
    ledger = secrets.Ledger(spark, space.subdir("ledger"))
    docs = _docs(spark, ["token=abcdefgh", "token=abcdefgh", "plain", None, ""])
    secrets.scan(docs, ledger, space).collect()
    first = _pairs(ledger)
    assert len(first) == 3 * len(secrets.RULES) == len(set(first))
    secrets.scan(docs, ledger, space).collect()
    assert _pairs(ledger) == first
    newer = secrets.Rule("assign", 2, secrets.RULES[0].pattern, 2, 9)
    rules = (newer, *secrets.RULES[1:])
    more = docs.unionAll(_docs(spark, ["new token=abcdefghi", "new"]))
    again = secrets.scan(more, ledger, space, rules=rules).collect()
    fresh = secrets.scan(more, secrets.Ledger(spark, space.subdir("other")), space, rules=rules).collect()
    assert sorted(map(str, again)) == sorted(map(str, fresh)) and sum(bool(r.findings) for r in again) == 1
    after = _pairs(ledger)
    assert len(after) == len(set(after)) == len(first) + 3 + 2 * len(rules)
    ledger.compact()
    assert _pairs(ledger) == after and ledger.rows().count() == 5
    assert sum(len(r.findings) for r in secrets.scan(docs, ledger, space).collect()) == 2
    assert _pairs(ledger) == after
    space.release()


def test_secrets_in_a_very_long_text(spark):
    space = Workspace(spark, "test-secrets")
    texts = ["x " * 400_000 + "token=abcdefgh " + "é" * 300_000 + " AKIA" + "Q" * 20, "token=abcdefgh\n" * 20_000]
    ledger = secrets.Ledger(spark, space.subdir("l"))
    found = {r.doc_id: r.findings for r in secrets.scan(_docs(spark, texts), ledger, space).collect()}
    assert [(s.kind, s.start, s.end) for s in found[0]] == [("assign", 800_000, 800_014), ("access", 1_100_016, 1_100_040)]
    assert len(found[1]) == 20_000
    kept = {r.doc_id: r.text for r in secrets.redact(_docs(spark, texts), secrets.Ledger(spark, space.subdir("r")), space).collect()}
    assert kept[1] == "[assign]\n" * 20_000
    space.release()


def test_redaction_keeps_the_rest(spark):
    space = Workspace(spark, "test-secrets")
    texts = ["é: token=abcdefgh, end", "clean é text", None, "api_key=" + "0123456789abcdef" * 2 + " tail"]
    docs = _docs(spark, texts)
    got = {r.doc_id: r.text for r in secrets.redact(docs, secrets.Ledger(spark, space.subdir("l")), space).collect()}
    assert got == {0: "é: [assign], end", 1: texts[1], 2: None, 3: "[assign] tail"}
    assert secrets.redact(docs.limit(0), secrets.Ledger(spark, space.subdir("e")), space).count() == 0
    space.release()


def test_redaction_hides_whole_keys(spark):
    space = Workspace(spark, "test-secrets")
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    lines = "\n".join(["MIIE" + "aB3+/" * 12] * 3)
    head = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n"
    texts = {
        f"é {begin}\n{lines}\nQw==\n{end} after": "é [pem] after",
        f"{begin}\r\n{head}> {lines}\n{end}\nmid\n{begin}\n{lines}\n{end}": "[pem]\nmid\n[pem]",
        f'"{begin}\\n' + lines.replace("\n", "\\n") + f'\\n{end}\\n"': '"[pem]\\n"',
        f"{begin}\n{head}{lines}\nQw==\nThe key was cut.": "[pem]\nThe key was cut.",
        f"{begin} {lines} and more": "[pem] and more",
        f"{begin}\n{lines}\n{begin}\n{lines}\n{end}.": "[pem]\n[pem].",
        f"{begin}\n{lines}\n-----END EC PRIVATE KEY-----": "[pem]\n-----END EC PRIVATE KEY-----",
        f"token={begin}\n{lines}\n{end} x": "[assign] x",
        f"A line {begin} begins it.": "A line [pem] begins it.",
    }
    docs = _docs(spark, list(texts))
    ledger = secrets.Ledger(spark, space.subdir("l"))
    secrets.scan(docs, ledger, space).collect()  # what scans noted of keys isn't taken for whole ones
    got = {r.doc_id: r.text for r in secrets.redact(docs, ledger, space).collect()}
    assert got == dict(enumerate(texts.values()))
    space.release()


# ---------------------------------------------------------------- 9 URLs


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://EXAMPLE.org/es/x", "http://sub.Example.org/en/12?q", "http://example.org", "http://badexample.org/es/", "http://x.com/de/", "http://x.com/DE/", "http://www.cheap-pills.example.net/a", "http://a.net/?u=cheap-pills.", "http://a.net/popunder.js#x", "http://x.com/fr/", "ftp://h://p/q", "http://ads-track.net/x/privacy/"]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)] + [(99, urls[3], "mine")], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlrules.judge_urls(df, urlrules.default_rules()).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == got[99] == ("example.org", "/es/x", "example.org/es/", "block")
    assert got[4] == ("sub.example.org", "/en/12", "example.org/en/1", "block")
    assert got[5] == ("example.org", "", None, "allow") and got[6] == ("badexample.org", "/es/", "org/", "allow")
    assert got[7][2:] == ("com/de/", "block") and got[8][2:] == (None, "allow")
    assert got[9][2:] == got[11][2:] == (None, "block") and got[10][3] == "allow"
    assert got[13][:2] == ("h:", "//p/q") and got[14][3] == "allow" and len(got) == len(urls) + 1
    assert urlrules.judge_urls(df.limit(0), urlrules.default_rules()).count() == 0


def test_url_rules_equal_running_every_rule(spark):
    rng = random.Random(5)
    parts = ["ads", "track", "shop", "a", "b1", "news"]
    rules = [urlrules.pattern_rule(rng.choice(["||", "", "|http://", "@@||", "@@"]) + rng.choice(parts) + rng.choice([".", "/", "^", "*", "-"]) + rng.choice(parts) + rng.choice(["", "^", "|", "/"])) for _ in range(60)]
    urls = [f"http://{rng.choice(parts)}.{rng.choice(parts)}-{rng.choice(parts)}.com/{rng.choice(parts)}/{rng.choice(parts)}{rng.choice(['', '?a=b', '/'])}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in urlrules.judge_urls(df, rules).collect()}

    def verdict(url):
        hit = {r.action for r in rules if re.search(r.pattern, url)}
        return "block" if hit == {"block"} else "allow"

    assert got == {i: verdict(u) for i, u in enumerate(urls)}

