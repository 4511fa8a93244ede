"""Search, extraction, tokens, conversations, the classifier and the pipeline against plain versions."""

import json
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arkline.llm import covertree, pieces, quotes, toxicity, wrappers
from arkline.llm.workspace import Workspace

# ---------------------------------------------------------------- 2 top k


def _plain_top(vectors, k):
    ok = {i: v for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in (i for i in ok if i % 20 == 0):
        score = lambda v: sum(int(np.floor(64 * a)) * int(np.floor(64 * b)) for a, b in zip(ok[q], v, strict=False))
        best = sorted((-score(v), i) for i, v in ok.items() if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("block", [2048, 40])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "QUERY_BLOCK", max(7, block // 20))
    monkeypatch.setattr(covertree, "PER_TASK", 2)
    monkeypatch.setattr(covertree, "SMALL", 3)
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(200)]
    rows += [(i, [0.5] * 6) for i in range(200, 300)]  # ties
    rows += [(301, None), (None, [1.0] * 6), (302, [1.0, None]), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (320, []), (305, [2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    space = Workspace(spark, "test-top")
    got = covertree.top_k(df, df.where("vec_id % 20 = 0"), space, k=7, factor=64.0)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == _plain_top(rows, 7)
    assert covertree.top_k(df.limit(0), df.limit(0), space).count() == 0
    space.release()


def test_large_components_stay_exact():
    a, b = (covertree.CoverTree(np.array([i]), np.array([[2.0**55 + 64, 3.0]])) for i in (1, 2))
    search = covertree.Search(a, 1, np.array([-np.inf]))
    search.run(b)
    assert list(search.score[0]) == [int(2.0**55 + 64) ** 2 + 9] and not search.exact


@pytest.mark.parametrize("spread, copies", [(40.0, 0), (3.0, 50), (0.0, 5)])
def test_cover_tree_levels(spread, copies):
    """Separation, covering, nesting and the covering radii, as the structure defines them."""
    rng = np.random.default_rng(1)
    centers = rng.normal(0, 100, (6, 5))
    points = np.floor(np.concatenate([c + rng.normal(0, spread, (60, 5)) for c in centers]))
    points = np.concatenate([points, points[:copies]])
    tree = covertree.CoverTree(np.arange(len(points)), points)
    assert sorted(tree.ids.tolist()) == list(range(len(points))) and (points[tree.ids] == tree.points).all()
    apart = lambda i, j: float(np.sqrt(((tree.points[i] - tree.points[j]) ** 2).sum()))
    deepest = max(tree.levels.values())
    for level in range(deepest + 1):
        radius = tree.top / 2**level
        net = [p for p, v in tree.levels.items() if v <= level]  # nesting: a net holds those before it
        assert all(apart(i, j) > radius - 1e-6 for i in net for j in net if i < j)
        assert all(min(apart(p, i) for i in net) <= radius + 1e-6 for p in range(len(points)))
    for p, above in tree.parent.items():
        assert tree.levels[above] < tree.levels[p] and apart(p, above) <= tree.top / 2 ** (tree.levels[p] - 1) + 1e-6
    stack, count = [tree.root], 0
    while stack:
        node = stack.pop()
        count += 1
        assert all(apart(node.center, i) <= node.radius for i in range(node.lo, node.hi))
        assert [node.bundle, *(c.hi for c in node.children)] == [*(c.lo for c in node.children), node.hi]
        assert all(c.level > node.level for c in node.children)
        stack += node.children
    assert count > 1 or not spread
    again = covertree.CoverTree.unpacked(tree.packed())
    assert (again.points == tree.points).all() and (again.ids == tree.ids).all()


def test_search_prunes_far_nodes():
    rng = np.random.default_rng(0)
    near, far = rng.normal(50, 1, (300, 4)), rng.normal(-50, 1, (700, 4))
    rows = np.floor(np.concatenate([near, far]))
    search = covertree.Search(covertree.CoverTree(np.arange(5000, 5010), np.floor(near[:10])), 5, np.full(10, -np.inf))
    search.run(covertree.CoverTree(np.arange(1000), rows))
    assert 0 < search.scored < 10 * 1000 / 2


# ---------------------------------------------------------------- 5 pages


ARTICLE = "<h1>Title &amp; more</h1><p><b>First  line<br>of&nbsp;it.<p>Second<script>no</script> one</p><ul><li>a<li>b</ul>"
PAGES = {
    f"<html><head><title>T</title></head><body><nav><a href=x>Home</a></nav><div class='ad'>Buy</div><article>{ARTICLE}<aside>no</aside></article><footer>c</footer>": ["Title & more", "First line of it.", "Second one", "a", "b"],
    f"<body><div id='cookie-notice'>We use</div><div class='site-header'>S</div><div class='post-content'>{ARTICLE}<form>f</form></div><div class='comments'><p>A long reader comment of many words</p></div>": ["Title & more", "First line of it.", "Second one", "a", "b"],
    "plain &lt;text": ["plain <text"],
    "<p>cut tag</p><p": ["cut tag"],
    "<article><p>x</p><!-- <p>no</p> --><style>p{}</style><p></p></article></div></p>": ["x"],
    "<main><table><tr><td>a<td>b</tr></table><blockquote>q</blockquote></main>": ["a b", "q"],
    "": [],
}


@pytest.mark.parametrize("html", list(PAGES))
def test_main_text(html):
    assert wrappers.main_text(html, None) == "\n\n".join(PAGES[html])


def test_wrapper_expression():
    pages = [f"<body><ul><li>Home<li>News</ul><div><h2>t{i}</h2>{'<p>long text %d of a paragraph</p>' % i * (i + 2)}{'<table></table>' if i == 1 else ''}</div></body>" for i in range(3)]
    whole = None
    for p in pages:
        own = wrappers.wrapper_of(wrappers.parse(p))
        whole = own if whole is None else wrappers.align(whole, own)
    assert wrappers.expression(whole) == '<>(<body>(<ul>(<li>(#)+) <div>(<h2>(#) <p>(#)+ <table>()?)))'
    assert wrappers.plan_of(whole)["path"] == ("body", "div")


def test_general_parts_stay_bounded():
    rng = random.Random(4)
    html = "".join(f"<{t}>x</{t}>" for t in rng.choices(["p", "h2", "pre", "blockquote", "div"], k=3000))
    wrapper = wrappers.wrapper_of(wrappers.parse(html))
    assert len(wrappers.expression(wrapper)) < 3000
    deep = "<div>" * 5000 + "end"
    assert wrappers.main_text(deep, None) == "end"


def test_pages_by_host(spark):
    fixed = "<p>Same notice on every page</p>"
    rows = [(i, f"http://h.net/{i}", f"<body><div><p>{'Some text of page %d. ' % i * 5}</p></div>{fixed}</body>", "own") for i in range(4)]
    rows += [(10, None, None, "own"), (11, "http://h.net/x", "", "own"), (12, "http://a.net", "<article><p>in</p></article>", "own"), (12, "http://a.net", "<article><p>in</p></article>", "own"), (13, "http://a.net", "<body><p>no article</p></body>", "own")]
    space = Workspace(spark, "test-pages")
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in wrappers.extract(df, space).collect()]
    texts = dict((i, t) for i, t, _ in got)
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert texts[2].startswith("Some text of page 2.") and "Same notice" not in texts[2]
    assert (texts[10], texts[11], texts[12], texts[13]) == ("", "", "in", "no article")
    assert wrappers.extract(df.limit(0), space).count() == 0
    space.release()


def _whole(pages):
    whole = None
    for p in pages:
        own = wrappers.wrapper_of(wrappers.parse(p))
        whole = own if whole is None else wrappers.align(whole, own)
    return wrappers.plan_of(json.loads(json.dumps(whole)))


def test_copies_are_one_page(spark):
    page = "<div class=post><h1>T</h1><p>short</p></div>"
    rows = [(i, "http://c.net/", page) for i in range(4)]
    rows += [(10 + i, "http://d.net/", f"{page}<!-- {i} --><div class=comments>{i}</div>") for i in range(4)]
    rows += [(20 + i, "http://e.net/", f"<p>Page {i}</p>{page}" if i else page) for i in range(4)]
    space = Workspace(spark, "test-copies")
    got = {r.page_id: r.text for r in wrappers.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), space).collect()}
    assert {got[i] for i in (0, 1, 2, 3, 10, 11, 12, 13, 20)} == {"T\n\nshort"}
    assert [got[i] for i in (21, 22, 23)] == ["Page 1", "Page 2", "Page 3"]
    space.release()


def test_the_element_holds_all_text():
    body = "<div class=head1><h1>Own title %d</h1></div><div class=content>{}</div><div class=more><p>Last words %d</p></div>".format("<p>Paragraph %d of this page</p>" * 30)
    pages = ["<body>" + body.replace("%d", str(i)) + "<div><p>Same on all</p></div></body>" for i in range(4)]
    plan = _whole(pages)
    assert plan["path"] == ("body",)
    assert wrappers.main_text(pages[2], plan) == "\n\n".join(["Own title 2", *["Paragraph 2 of this page"] * 30, "Last words 2"])
    # general parts count once, and only some pages hide a part
    mixed = ["<body><section>" + "".join(f"<{t}>{i} {t}</{t}>" for t in random.Random(i).choices(["p", "h2", "pre", "ul"], k=90)) + f"</section><div{' hidden' if i else ''}>Note {i}</div></body>" for i in range(3)]
    assert "Note 0" in wrappers.main_text(mixed[0], _whole(mixed))


def test_fixed_texts_go_at_their_place_only():
    pages = [f"<body><div><p>Menu</p><h1>Title {i}</h1><div><p>{'Menu' if i == 1 else i}</p><p>Text {i}</p></div>{'<div class=w><p>Rare</p></div>' if i < 3 else ''}</div></body>" for i in range(5)]
    plan = _whole([*pages, "", "<body></body>"])
    assert wrappers.main_text(pages[1], plan) == "Title 1\n\nMenu\n\nText 1\n\nRare"


@pytest.mark.parametrize("kinds", [3, 90])
def test_long_texts_and_many_parts_are_fixed_too(kinds):
    """A template text of 300 characters, beside few parts and beside so many that they are generalised."""
    long = "fixed " * 50
    parts = lambda i: "".join(f"<{t}>{i} {k} {t}</{t}>" for k, t in enumerate(random.Random(i).choices(["p", "h2", "pre", "h3", "div"], k=kinds)))
    pages = [f"<body><section><div><p>{long}</p></div>{parts(i)}</section></body>" for i in range(4)]
    got = wrappers.main_text(pages[2], _whole(pages))
    assert long.strip() not in got and got.count("\n\n") == kinds - 1
    assert long.strip() in wrappers.main_text(pages[2], _whole(pages[:2]))


def test_noise_below_the_deepest_level_stays_out():
    nest = lambda n, inner: "<div>" * n + inner + "</div>" * n
    html = nest(200, "<nav>menu menu</nav><p>text</p><aside>ad</aside>")
    assert wrappers.main_text(html, None) == "text"
    assert wrappers.main_text(html, _whole([html] * 3)) == "text"


def test_deep_nests_keep_their_ends():
    nest = lambda n, inner: "<div>" * n + inner + "</div>" * n
    html = f"<body><div class=x><article><p>a</p>{nest(400, 'deep <p>in</p> after<ul class=menu><li>no</ul>')}<p>last</p></article></div><p>out</p>"
    assert wrappers.main_text(html, None) == "a\n\ndeep\n\nin\n\nafter\n\nlast"
    html = f"<body><p>menu</p>{nest(300, '<article><header><h1>h</h1></header><article>x</article>y</article><p>no</p>')}"
    assert wrappers.main_text(html, None) == "h\n\nx\n\ny"
    for n in range(wrappers.DEEPEST - 5, wrappers.DEEPEST + 5):
        pages = [nest(n, f"<p>Same</p><div class=a><p>{i}</p></div><p>Own {i}</p><div class=b>z</div>") for i in range(4)]
        own = wrappers.main_text(pages[3], None)
        assert own == "Same\n\n3\n\nOwn 3\n\nz"
        got = wrappers.main_text(pages[3], _whole(pages)).split("\n\n")
        assert [x for x in got if x not in ("Same", "z")] == ["3", "Own 3"]
        article = [nest(n, f"<p>no</p><article><p>{i}</p><div><p>Same</p></div></article>") for i in range(4)]
        assert wrappers.main_text(article[3], _whole(article)) == "3\n\nSame"
    assert wrappers.main_text("<div>" * 60_000 + "end" + "</p>" * 60_000, None) == "end"


# ---------------------------------------------------------------- 7 pieces


def _model(kind, fallback=True):
    from sentencepiece import sentencepiece_model_pb2 as proto

    m = proto.ModelProto()
    with open(pieces.default_model(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = kind, fallback
    for i, p in enumerate(m.pieces):
        if not fallback and p.type == 6:
            p.type, p.piece = 5, "unused" + p.piece
        if kind == pieces.UNIGRAM and p.type == 1:
            p.score = -float(np.log(i + 1.7))
    return m.SerializeToString()


def _texts():
    rng = random.Random(1)
    alphabet = "abcdeinoth ▁ s.,é😀=-_1 \n"
    fixed = ["", " ", "  a  b ", "\n\n x", "ラーメン世界abc", "a" * 3000, "    " * 50, "▁▁a▁b", "ab" * 2000, "=" * 999, "日本語のテキスト" * 100, "the quick brown fox " * 20]
    return fixed + ["".join(rng.choices(alphabet, k=rng.randint(1, 200))) for _ in range(400)]


@pytest.mark.parametrize("fallback", [True, False])
def test_bpe_ids_equal_the_library(fallback):
    import sentencepiece

    data = _model(pieces.BPE, fallback)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Codec(pieces.ModelFile.parse(data))
    for text in _texts():
        ids = list(own.encode(text))
        assert ids == library.encode(text)
        assert own.decode(ids) == library.decode(ids)


def test_unigram_paths_are_as_good_as_the_library():
    """Paths of equal score may differ: the library adds scores in another order."""
    import sentencepiece

    data = _model(pieces.UNIGRAM)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Codec(pieces.ModelFile.parse(data))
    weight = lambda ids: sum(own.model.scores[i] if own.model.types[i] == 1 else 0 for i in ids)
    for text in _texts():
        mine, theirs = list(own.encode(text)), library.encode(text)
        assert mine == theirs or abs(weight(mine) - weight(theirs)) < 1e-2 * max(1, len(mine))


@pytest.mark.parametrize("words, segment", [(400_000, 1 << 18), (60, 200)])
def test_texts_together_equal_the_library(monkeypatch, words, segment):
    """Many texts at once, also with caches that fill up and texts cut into many pieces."""
    import sentencepiece

    monkeypatch.setattr(pieces, "WORDS", words)
    monkeypatch.setattr(pieces, "SEGMENT", segment)
    data = _model(pieces.BPE)
    library, own = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Codec(pieces.ModelFile.parse(data))
    rng = random.Random(9)
    bits = [" ", "  ", "a", "the", "\n", "▁", "é", "日本", "\U0001f600", "\x00", "Hello", "world.", "x" * 90]
    texts = [None, *_texts(), *("".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(300))]
    got = []
    for begin, ids, counts, equal in own.encode_all(pa.array(texts)):
        assert begin == len(got) and equal.all()
        ends = np.cumsum(counts)
        got += [ids[a:b].tolist() for a, b in zip(ends - counts, ends, strict=True)]
    assert got == [library.encode(t or "") for t in texts]
    broken = list(own.encode_all(pa.array([b"ok \xff \xe2\x96", b"", b"\x96\x81 x"], pa.binary())))
    assert [int(n) for part in broken for n in part[2]] == [len(library.encode(t)) for t in ("ok \ufffd \ufffd", "", "\ufffd\ufffd x")]


def test_tables_hold_what_was_added():
    rng = np.random.default_rng(0)
    table, keys = pieces._Table(10), rng.choice(1 << 40, 600, replace=False)
    table.add(keys[:300], np.arange(300))
    assert (table.get(keys[:300]) == np.arange(300)).all() and (table.get(keys[300:]) == -1).all()
    table.add(keys[300:], np.arange(300, 600))
    assert (table.get(keys) == np.arange(600)).all() and table.count == 600


def test_search_commits_early():
    codec = pieces.Codec(pieces.ModelFile.parse(_model(pieces.BPE)))
    sizes, meeting = [], codec._meeting
    codec._meeting = lambda back, rel: (sizes.append(len(back)), meeting(back, rel))[1]
    assert len(list(codec._search("abc" * 30_000))) > 0
    assert max(sizes) < 10 * (pieces.CHECK_EVERY + codec.longest)


def test_encode_and_decode_frames(spark):
    texts = [None, "", "héllo wörld", "x" * 5000, "a\tb\n", "😀"]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, n_ids int")
    encoded = pieces.encode(df, pieces.default_model())
    rows = {r.doc_id: r for r in encoded.collect()}
    assert all(r.round_trip and r.n_ids == len(r.ids) for r in rows.values()) and rows[0].n_ids == rows[1].n_ids == 0
    back = {r.doc_id: r.text for r in pieces.decode(encoded, pieces.default_model()).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert pieces.encode(df.limit(0), pieces.default_model()).count() == 0


# ---------------------------------------------------------------- 8 conversations


def test_quotes_link_to_originals(spark):
    rows = [
        (1, 0, "user", "Hello there\nhow are you?"),
        (1, 1, "assistant", "Fine thanks.\nAnd you?"),
        (1, 2, "human", "On Monday X wrote:\n> Hello  there\n> how are you?\n\nSecond reply"),
        (1, 3, "assistant", "> > Hello there\n> Second reply\nThird"),
        (1, 4, None, ">>> hello there\n>> second reply\n> Third\nfourth"),
        (1, 5, "user", "> nothing known\nfive"),
        (2, 0, "user", None),
        (None, 1, "x", "> a\nb"),
        (3, 1, "user", "> same\n"),
        (3, 0, "user", "same"),
        (3, 0, "user", "same"),
    ]
    space = Workspace(spark, "test-quotes")
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    got = sorted((r.conv_id or 0, r.reply_order, r.turn, r.reply_to, r.depth, r.role, r.content) for r in quotes.link(df, space).collect())
    order = [r[2] for r in got if r[0] == 1]
    assert order == [0, 2, 3, 4, 1, 5]
    assert {r[2]: (r[3], r[4]) for r in got if r[0] == 1} == {0: (None, 0), 1: (None, 0), 2: (0, 1), 3: (2, 2), 4: (3, 3), 5: (None, 0)}
    assert {r[2]: r[6] for r in got if r[0] == 1}[2] == "Second reply"
    assert [r[2:5] for r in got if r[0] == 3] == [(0, None, 0), (0, None, 0), (1, 0, 1)]
    assert all(">" not in r[6] for r in got) and quotes.link(df.limit(0), space).count() == 0
    space.release()


def _plain_links(messages):
    """{turn: (parent, linked hashes)} of one conversation by comparing every text with every other."""
    parsed = {t: quotes.parse(text or "") for t, text in messages}
    own = {}
    for t, (body, _) in parsed.items():
        own[t] = {quotes.normalised(x) for x in [body, *re.split(r"\n\s*\n", body), *body.split("\n")]} - {""}
    out = {}
    for t, (_, passages) in parsed.items():
        by_level, found = {}, set()
        for level, passage in passages:
            for part in {passage, *passage.split("\n")}:
                text = quotes.normalised(part)
                earlier = [u for u in own if u < t and text in own[u]]
                if text and earlier:
                    found.add(text)
                    known = by_level.setdefault(level, {}).setdefault(min(earlier), {})
                    known[text] = max(known.get(text, (0, 0)), (int(part == passage), len(text)))
        if by_level:
            best = by_level[min(by_level)]
            out[t] = (max(best, key=lambda u: (max(best[u].values()), len(best[u]), u)), len(found))
    return out


def test_quotation_links_equal_brute_force(spark):
    rng = random.Random(5)
    lines = [f"line {k} of some words" for k in range(12)] + ["fine", "yes", "A  longer LINE here", ""]
    rows, base = [], 1_700_000_000_000  # turns of 13 digits
    for conv in range(25):
        texts = []
        for turn in range(rng.randrange(1, 14)):
            parts = []
            for _ in range(rng.randrange(0, 3)):
                if texts:
                    quoted = rng.choice(texts).split("\n")
                    some = quoted if rng.random() < 0.5 else [rng.choice(quoted)]
                    parts += ["> " * rng.choice([1, 1, 2]) + x.upper() for x in some]
                parts.append(rng.choice(lines))
            parts += rng.choices(lines, k=rng.randrange(0, 3))
            texts.append("\n".join(parts))
            rows.append((conv, base + turn, "user", texts[-1]))
    rows += [(50, 0, "user", "The long unique opening question."), (50, 1, "bot", "fine"), (50, 2, "user", "> The long unique opening question.\n> fine\nsee")]
    rows += [(60, t, "user", f"> m{t - 1}\nm{t}") for t in range(40)]  # a chain
    space = Workspace(spark, "test-quotes")
    linked = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), space)
    got = {}
    for r in linked.collect():
        got.setdefault(r.conv_id, []).append(r)
    units = {r.conv_id: [m.content for m in r.messages] for r in quotes.conversations(linked.coalesce(1)).collect()}
    for conv, own in got.items():
        want = _plain_links([(t, x) for c, t, _, x in rows if c == conv])
        assert {r.turn: (r.reply_to, r.n_linked) for r in own if r.reply_to is not None} == want
        below = {}
        for r in own:
            below.setdefault(want.get(r.turn, (None,))[0], []).append(r.turn)
        order, stack = [], [(t, 0) for t in sorted(below.get(None, []), reverse=True)]
        while stack:
            t, depth = stack.pop()
            order.append((t, depth))
            stack += [(u, depth + 1) for u in sorted(below.get(t, []), reverse=True)]
        own.sort(key=lambda r: r.reply_order)
        assert [(r.turn, r.depth) for r in own] == order
        assert units[conv] == [r.content for r in own]
    assert {r.reply_to for r in got[50]} == {None, 0} and max(len(r.reply_order) for r in got[60]) < 40
    space.release()


def test_messages_with_odd_bytes_and_great_length(spark):
    space = Workspace(spark, "test-quotes")
    long = "word " * 200_000 + "end"
    rows = [(1, 0, b"odd \xff bytes"), (1, 1, b"> odd \xff bytes\nok"), (1, 2, long.encode()), (1, 3, b"> " + long.encode() + b"\nyes"), (1, None, b"x"), (None, 1, b"> x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text binary").select("conv_id", "turn", F.expr("cast(null as string)").alias("role"), F.col("text").cast("string"))
    got = {(r.conv_id, r.turn): (r.reply_to, r.role, len(r.content)) for r in quotes.link(df, space).collect()}
    assert got[1, 1] == (0, "user", 2) and got[1, 3] == (2, "user", 3) and got[1, 2][2] == len(long)
    space.release()


# ---------------------------------------------------------------- 10 toxicity


def _labelled(spark, n=500):
    rng = random.Random(8)
    bad, words = ["vilezz", "nastyqq"], [f"w{k}" for k in range(300)]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.4)
        text = rng.choices(words, k=rng.randint(5, 60))
        for _ in range(3 * toxic):
            text[rng.randrange(len(text))] = rng.choice(bad) + rng.choice(["", "s", "ing"])
        rows.append((i, " ".join(text), rng.choice(["en", "de"]), toxic))
    return rows, spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string"), spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")


def test_classifier_on_held_out_rows(spark):
    rows, docs, labels = _labelled(spark)
    model = toxicity.fit(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = {r.doc_id: r.score for r in toxicity.score(docs.where(toxicity.held_out(F.col("doc_id"))), model).collect()}
    hits = [(scored[i] >= 0.5) == bool(toxic) for i, _, _, toxic in rows if i in scored]
    assert len(hits) > 100 and sum(hits) / len(hits) >= 0.9


def test_responses_equal_a_plain_convolution():
    """Every filter at every place of every text, one by one."""
    rng = np.random.default_rng(3)
    model = toxicity.Model.new(5)
    model.bias[:] = rng.normal(0, 0.1, model.bias.shape)
    texts = ["", "one", "one two", " ".join(f"w{k}" for k in range(40)), "Ünï çode wörds here", "x " * 300, "a b c"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    buckets, first = toxicity.features(np.frombuffer(data, np.uint8), offsets)
    got = model.forward(buckets, first)[0]
    for d in range(len(texts)):
        words = [sum(model.embedding[b] for b in row) for row in buckets[first[d] : first[d + 1]]]
        assert len(words) == len(re.findall(r"[0-9a-z\x80-\U0010ffff]+", texts[d].lower())) or texts[d] == "a b c"
        want = []
        for i, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                replies = [float(np.concatenate(words[k : k + w]) @ model.filters[i][:, f]) for k in range(len(words) - w + 1)]
                want.append(max(0.0, max(replies) + float(model.bias[i * toxicity.FILTERS + f])) if replies else 0.0)
        assert np.allclose(got[d], want, atol=1e-4)
    raw = got @ model.out + model.out_bias
    assert np.allclose(model.score(buckets, first), 1 / (1 + np.exp(-raw.astype(float))), atol=1e-6)


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i} " * (1 + 500 * (i == 7)), "en") for i in range(120)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2 + [(0, 1), (None, 1), (3, None), (999, 0)], "doc_id long, toxic int")
    rows, _ = toxicity.sample_labels(docs, labels, 9, 1000)
    assert {y: sum(r[1] == y for r in rows) for y in (0, 1)} == {0: 9, 1: 9} and sum(len(t) for t, _, _ in rows) < 2000
    every, share = toxicity.sample_labels(docs, labels)
    assert len(every) == 123 and all(s == 1.0 for s in share)
    assert toxicity.sample_labels(docs.limit(0), labels)[0] == []
    model = toxicity.fit(docs.limit(0), labels)
    assert toxicity.score(docs.limit(0), model).count() == 0 and all(r.score < 1e-9 for r in toxicity.score(docs, model).collect())


def test_the_sample_comes_in_few_jobs_and_is_held_as_bucket_numbers(spark, monkeypatch):
    rows, docs, labels = _labelled(spark, 300)
    held, train = [], toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts: held.extend(texts) or train(texts))
    own = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        began = jobs()
        toxicity.fit(docs, labels)
        assert jobs() - began < 40  # not one for each partition
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(len(t) for t, _ in held) > 3000 and all(t.nbytes <= 8 * len(t) for t, _ in held)
    text = rows[0][1].encode()
    data = np.frombuffer(text, np.uint8)
    kept = toxicity.sample_labels(docs.where("doc_id = 0"), labels, kept=lambda t: toxicity.features(t, np.array([0, len(t)]))[0])[0]
    assert (kept[0][0] == toxicity.features(data, np.array([0, len(data)]))[0]).all() and toxicity.sample_labels(docs.where("doc_id = 0"), labels)[0][0][0] == text


def test_very_long_and_repeated_documents(spark):
    rows, docs, labels = _labelled(spark, 120)
    model = toxicity.fit(docs, labels)
    long = "w1 " * 400_000
    more = spark.createDataFrame([(900, long + "vilezz nastyqq", "en"), (901, long, "en"), (1, rows[1][1], "xx"), (1, rows[1][1], "en"), (902, None, None)], "doc_id long, text string, lang string")
    got = [(r.doc_id, r.score) for r in toxicity.score(more, model).collect()]
    assert dict(got)[900] > dict(got)[901] and len({s for i, s in got if i == 1}) == 1 and len(got) == 5


def test_scores_don_t_depend_on_the_batch(spark):
    rng = np.random.default_rng(0)
    model = toxicity.Model.new()
    texts = [b"", b"one", b"one two", b"a b c d e f g", b"\xff broken", b"x" * 3000]
    alone = []
    for t in texts:
        data = np.frombuffer(t, np.uint8)
        alone.append(model.score(*toxicity.features(data, np.array([0, len(data)])))[0])
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    assert np.allclose(model.score(*toxicity.features(data, offsets)), alone) and rng is not None


def test_odd_labels(spark):
    docs = spark.createDataFrame([(1, "a", "en", 5.0), (2, None, None, 5.0)], "doc_id long, text string, lang string, score double")
    for labels in ([], [(1, None)], [(9, 1)], [(1, 0), (1, 0)]):
        model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [round(r.score, 6) for r in toxicity.score(docs, model).collect()] == [0, 0]
    model = toxicity.fit(docs, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))
    assert [round(r.score, 6) for r in toxicity.score(docs, model).collect()] == [1, 1]
