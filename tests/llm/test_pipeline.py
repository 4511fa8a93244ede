"""Every stage of the pipeline, row by row, against a plain version on what the stage before kept."""

import re
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from arkline.llm import pieces, secrets, toxicity
from arkline.llm.workspace import Workspace

pipeline = pytest.importorskip("corpus_pipeline")


def _plain_toxic(spark, docs, data):
    """Rows below the threshold of their language, scored one text at a time."""
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    out = []
    for r in docs.collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        score = model.score(*toxicity.features(raw, np.array([0, len(raw)])))[0]
        if score < model.thresholds.get(r.lang, model.thresholds.get(None, toxicity.PREDICT_AT)):
            out.append((r.doc_id, r.text))
    return out


def _plain_near_copies(spark, docs, data):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets, holders = [], defaultdict(list)
    for i, (_, text) in enumerate(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set()))
        for g in sets[-1]:
            holders[g].append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for g in s for j in holders[g] if j < i}:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (k, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), k), k)
    return [row for i, row in enumerate(rows) if row[0] == best[find(i)]]


def _plain_cuts(spark, docs, data):
    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
    windows = set()
    for r in spark.read.parquet(f"{data}/benchmark.parquet").collect():
        own = [w.lower() for w in word.findall((r.text or "").encode())]
        size = min(10, len(own))
        windows |= {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if size else set()
    out = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        found = list(word.finditer(raw))
        own, hit = [m[0].lower() for m in found], set()
        for size in {len(w) for w in windows}:
            for i in range(len(own) - size + 1):
                if tuple(own[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
        if len(hit) > pipeline.MAX_COVERAGE * len(own):
            continue
        kept, to = b"", 0
        for i in sorted(hit):
            if i - 1 not in hit:
                kept += raw[to : found[i].start()]
            to = found[i].end()
        out.append((r.doc_id, r.text if not hit else (kept + raw[to:]).decode()))
    return out


def _plain_secrets(spark, docs, data):
    out = []
    for r in docs.collect():
        text = r.text or ""
        spans = sorted((m.start(), k, m.end(), rule.kind) for k, rule in enumerate(secrets.WHOLE) for m in re.finditer(rule.pattern, text) if len(m[rule.group]) >= rule.least)
        hidden, to = "", 0
        for begin, _, end, kind in spans:
            if begin >= to:
                hidden += text[to:begin] + f"[{kind}]"
            to = max(to, end)
        out.append((r.doc_id, hidden + text[to:] if spans else r.text))
    return out


PLAIN = {"toxicity": _plain_toxic, "near_copies": _plain_near_copies, "decontamination": _plain_cuts, "secrets": _plain_secrets}


def test_stages_equal_plain_versions(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    key = "-----BEGIN RSA PRIVATE KEY-----\n" + "MIIEow" * 12 + "\n-----END RSA PRIVATE KEY-----"
    more = [(10_001, f"é some text with password = 'abcdefgh1' and {key} in it", "en"), (10_002, "the hash 0123456789abcdef0123456789abcdef is long api_key:0123456789abcdef0123456789abcdef", "en")]
    extra = spark.createDataFrame([(i, t, g, "x", len(t)) for i, t, g in more], docs.schema)
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{data}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    data = str(tmp_path)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    space, changed = Workspace(spark, "test-pipeline"), {}
    for name, stage in pipeline.STAGES[:-1]:
        want = PLAIN[name](spark, docs, data)
        before = {(r.doc_id, r.text) for r in docs.collect()}
        after = stage(spark, docs, data)
        assert after.columns == docs.columns, name
        docs = space.table(after)
        got = [(r.doc_id, r.text) for r in docs.collect()]
        assert sorted(got, key=str) == sorted(want, key=str), name
        assert docs.where("n_chars <> length(text)").isEmpty(), name
        changed[name] = set(got) != before
    assert all(changed.values()), changed
    with open(pieces.default_model(), "rb") as f:
        library = sentencepiece.SentencePieceProcessor(model_proto=f.read())
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    last = pipeline.STAGES[-1][1](spark, docs, data).collect()
    assert {r.doc_id: list(r.ids) for r in last} == {k: library.encode(t) for k, t in texts.items()}
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in last)
    whole = {r.doc_id: list(r.ids) for r in pipeline.run(spark, data).collect()}
    assert whole == {r.doc_id: list(r.ids) for r in last}
    space.release()


def _folder(spark, tmp_path, docs, labels=(), benchmark=()):
    kind = "doc_id long, raw binary, lang string, source string, n_chars long, score int, findings string, ids string, _set string"
    frame = spark.createDataFrame([(*d, "x", 1, 7, "f", "i", "s") for d in docs], kind)
    frame.select("doc_id", F.col("raw").cast("string").alias("text"), *frame.columns[2:]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(benchmark), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_odd_documents_pass_through(spark, tmp_path):
    long = ("word " * 60_000 + "token=abcdefgh12 ").encode()
    docs = [(1, None, "en"), (2, b"", "en"), (3, b"some words \xff that are kept as they are", None), (4, long, "en"), (5, b"twice the same text in two rows here", "en"), (5, b"twice the same text in two rows here", "en"), (None, b"no id but a text of its own", "en"), (7, b" \t ", "en")]
    folder = _folder(spark, tmp_path, docs, benchmark=[(1, "one two three four five"), (2, None), (3, "")])
    assert sorted((r.doc_id or 0) for r in pipeline.run(spark, folder).collect()) == [0, 1, 2, 3, 4, 5, 7]
    space, table = Workspace(spark, "test-pipeline"), spark.read.parquet(f"{folder}/documents.parquet")
    columns = table.columns
    for name, stage in pipeline.STAGES[:-1]:
        table = space.table(stage(spark, table, folder))
        assert table.columns == columns, name
    texts = {r.doc_id: r.b for r in table.select("doc_id", F.col("text").cast("binary").alias("b"), "n_chars").collect()}
    assert texts[1] is None and bytes(texts[3]) == docs[2][1] and bytes(texts[4]) == b"word " * 60_000 + b"[assign] "
    assert {tuple(r) for r in table.select("score", "findings", "ids", "_set").collect()} == {(7, "f", "i", "s")}
    space.release()


def test_empty_tables(spark, tmp_path):
    assert pipeline.run(spark, _folder(spark, tmp_path, [])).count() == 0
