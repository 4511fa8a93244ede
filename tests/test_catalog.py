import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from arkline.functions import kernels, masks, paths
from arkline.operators import catalog, dedup, leaderboard, planner
from arkline.plans import catalog_queries as q


def _rows(columns, rows):
    """Rows as sorted texts, columns in the order of their names, whole floats as integers."""
    cell = lambda v: int(v) if isinstance(v, float) and v == int(v) else v
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(str([cell(r[i]) for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_equals_sql(spark, data, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "labels", "conversations", "events", "orders", "lineitem", "part", "customer", "supplier"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    want = db.execute(q.ORACLE_SQL[name])
    got = q.QUERIES[name](spark, data)
    assert _rows(got.columns, got.collect()) == _rows([c[0] for c in want.description], want.fetchall())


def test_masks(spark):
    df = spark.createDataFrame([("a/b.txt",), ("b.txt",), ("b.txt\n",), ("x.dat",), ("B.TXT",)], "n string")
    hit = lambda c: [r.n for r in df.where(c).collect()]
    assert hit(masks.included(F.col("n"), ["b.tx?"])) == ["a/b.txt", "b.txt"]
    assert hit(masks.matches(F.col("n"), "b.*", False)) == ["b.txt", "b.txt\n", "B.TXT"]
    assert hit(masks.excluded(F.col("n"), [".\\a/"])) == ["a/b.txt"]


def test_paths(spark):
    df = spark.createDataFrame([("C:\\a\\..\\..\\con.txt /x:y. ",), ("",), ("/../..",), ("a//./b",)], "n string")
    assert [r[0] for r in df.select(paths.sanitised(F.col("n"))).collect()] == ["_con.txt/x_y", "", "", "a/b"]
    links = spark.createDataFrame([("a/l", "../b"), ("a/l", "../../b"), ("l", "/etc"), ("l", "x/../y")], "p string, t string")
    assert [r[0] for r in links.select(paths.link_escapes(F.col("p"), F.col("t"))).collect()] == [False, True, True, False]
    names = spark.createDataFrame([("x.part9.rar",), ("x.part99.rar",), ("x",), ("x7.exe",)], "n string")
    assert [r[0] for r in names.select(paths.next_volume(F.col("n"))).collect()] == ["x.part10.rar", "x.part100.rar", "x.part01.rar", "x8.rar"]
    old = spark.createDataFrame([("x.rar",), ("x.r00",), ("x.r99",), ("x.z99",)], "n string")
    assert [r[0] for r in old.select(paths.next_volume(F.col("n"), True)).collect()] == ["x.r00", "x.r01", "x.s00", "x.z99"]


def test_diff_takes_the_last_of_equal_paths(spark):
    schema = "entry_idx long, name string, unp_size long, crc32 long, mtime_win long, method int"
    old = spark.createDataFrame([(0, "a", 1, 1, 0, 0), (1, "a", 2, 1, 0, 0), (2, "d/", 0, None, 0, 0)], schema)
    new = spark.createDataFrame([(0, "a", 2, 1, 9, 0), (1, "d", 0, 0, 0, 0), (2, "n", 1, 1, 0, 0)], schema)
    assert {r.path: r.kind for r in catalog.diff(old, new).collect()} == {"a": "metadata_diff", "d": "identical", "n": "added"}


def test_collision_classes(spark):
    def classes(*names):
        rows = [(i, n, False) for i, n in enumerate(names)]
        return [r.cls for r in dedup.collisions(spark.createDataFrame(rows, "entry_idx long, name string, is_dir boolean")).collect()]

    assert classes("a", "a") == ["duplicate"]
    assert classes("Readme", "README") == ["case_fold"]
    assert classes("\u00e9", "e\u0301") == ["nfc"]
    assert classes("foo", "foo/bar") == classes("foo/bar", "foo") == ["file_vs_dir"]
    assert classes("a", "b", "ab/c") == []


@pytest.mark.parametrize(
    "hashes, references, order",
    [
        ([[1, 2, 3, 4], [10, 11, 12, 13], [1, 2, 3, 99]], {}, [0, 2, 1]),
        ([[1, 2, 3, 4], [5, 6, 7, 8], [1, 2, 5, 6]], {}, [0, 2, 1]),
        ([list(range(1, 11)), [20, 21, 22, 23], [1, 2, 3]], {}, [0, 2, 1]),
        ([[], [], []], {}, [0, 1, 2]),
        ([[1], [2], []], {2: 0}, [0, 2, 1]),
    ],
)
def test_affinity_order(spark, hashes, references, order):
    files = spark.createDataFrame([(i, references.get(i)) for i in range(len(hashes))], "file_idx long, reference_of long")
    chunks = spark.createDataFrame([(i, h) for i, hs in enumerate(hashes) for h in hs], "file_idx long, hash long")
    assert [r.file_idx for r in planner.affinity_order(files, chunks).orderBy("position").collect()] == order


def test_parity_digest_covers_all_shards(spark, tmp_path):
    texts = [None, "", "a" * 900, "".join(map(chr, range(97, 123))) * 5200]
    spark.createDataFrame([(i, t, len(t or ""), "s", "en") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.entry_idx: r for r in q.gf_parity(spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        data, d = (text or "").encode(), got[i].d
        size = -(-len(data) // d) if data else 0
        size += size % 2
        shards = kernels.parity([data.ljust(d * size, b"\0")[k * size : (k + 1) * size] for k in range(d)], got[i].nr) if data else []
        assert got[i].parity_sha256 == hashlib.sha256(b"".join(shards)).hexdigest()
    assert got[3].nr > 3


def test_ci_duplicates_by_any_brand(spark):
    ci = spark.createDataFrame([(f"brand {i:04}", "ci") for i in range(1500)] + [("é", "ci"), ("", "ci"), (None, "ci")], "brand string, system string")
    brands = [f"brand {i:04}" for i in range(1500)] + ["brand 0007 plus", "brand", "été", "e", "", None]
    community = spark.createDataFrame([(i, "own", b) for i, b in enumerate(brands)] + [(-1, "ci", ""), (-2, "own", "new"), (-2, "own", "new")], "n long, system string, brand string")
    kept = leaderboard.without_ci_duplicates(community, ci)
    assert kept.columns == ["brand", "system", "n"]
    assert sorted((r.n, r.brand) for r in kept.collect() if r.brand is not None) == [(-2, "new"), (-2, "new"), (1501, "brand"), (1503, "e"), (1504, "")]
    assert kept.where("brand IS NULL").count() == 1


def _plain_sanitised(path):
    done = []
    for part in re.sub("^/+", "", re.sub("^[A-Za-z]:", "", path.replace("\\", "/"))).split("/"):
        if part == "..":
            done = done[:-1]
        elif part not in ("", "."):
            clean = re.sub(r"[. ]+$", "", re.sub(r'[\x00-\x1f<>"|?*:]', "_", part))
            reserved = re.sub(r"[. ]+$", "", clean.split(".")[0]).lower() in paths.RESERVED
            done.append("_" if not clean else "_" * reserved + clean)
    return "/".join(done)


def test_all_paths_are_sanitised(spark, tmp_path):
    rng = random.Random(9)
    urls = [None, ""] + ["http://" + "/".join(rng.choices(["a", "b.c", ".", "..", "...", "x. ", " y", "", "con", "NUL.txt", "q?z:1", "e\\f"], k=rng.randint(1, 8))) for _ in range(400)]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.entry_idx: r.path for r in q.sanitised_all_paths(spark, str(tmp_path)).collect()}
    assert got == {i: None if u is None else _plain_sanitised("C:/../" + re.sub("^[^:]*://", "", u) + "/") for i, u in enumerate(urls)}
