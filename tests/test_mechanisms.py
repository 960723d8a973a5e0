"""Interval joins, quantiles, running totals and split CSV records against brute force."""

import csv
import math
import random
from bisect import bisect_right

import pytest
from pyspark.sql import functions as F

from tally.operators.prefix import moving, running
from tally.operators.quantiles import quantiles
from tally.operators.rangejoin import interval_join
from tally.sources.csvrecords import ends_inside, records
from tally.sources.files import read_csv_section


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_interval_join(spark):
    rng = random.Random(3)
    points = [(k, rng.choice(["a", "b", None]), rng.choice([None, 7.5, rng.uniform(-50, 50)])) for k in range(400)]
    spans = [(k, rng.choice(["a", "b", None]), lo, lo + rng.choice([0.0, -1.0, 1e-7, 0.3, 5.0, 80.0])) for k, lo in ((k, rng.choice([7.5, rng.uniform(-60, 50)])) for k in range(150))]
    spans += [(900, "a", None, 3.0), (901, "b", 1.0, None)]
    left = spark.createDataFrame(points, "p long, g string, x double")
    right = spark.createDataFrame(spans, "i long, g string, lo double, hi double")
    for closed in (False, True):
        hit = lambda x, lo, hi: None not in (x, lo, hi) and (lo <= x <= hi if closed else lo <= x < hi)
        for size in (10, 200_000):
            got = interval_join(left, right, "x", "lo", "hi", on=["g"], closed=closed, bin_points=size)
            assert "NestedLoop" not in _plan(got) and "Cartesian" not in _plan(got)
            want = sorted((p, i) for p, g, x in points for i, h, lo, hi in spans if g == h and g is not None and hit(x, lo, hi))
            assert sorted((r.p, r.i) for r in got.collect()) == want
        free = interval_join(left.drop("g"), right.drop("g"), "x", "lo", "hi", closed=closed, bin_points=5)
        assert sorted((r.p, r.i) for r in free.collect()) == sorted((p, i) for p, _, x in points for i, _, lo, hi in spans if hit(x, lo, hi))


def test_interval_join_edges(spark):
    left = spark.createDataFrame([(1, 5)] * 3, "p long, x int")
    right = spark.createDataFrame([(1, 5, 5), (1, 5, 5), (2, 0, 2**31 - 1)], "i long, lo int, hi int")
    assert interval_join(left, right, "x", "lo", "hi").count() == 3
    assert interval_join(left, right, "x", "lo", "hi", closed=True).count() == 9
    assert interval_join(left, right.limit(0), "x", "lo", "hi").count() == 0
    assert interval_join(left.limit(0), right, "x", "lo", "hi").count() == 0
    with pytest.raises(ValueError):
        interval_join(left, right.withColumnRenamed("i", "p"), "x", "lo", "hi")


@pytest.mark.parametrize("discrete", [False, True])
def test_quantiles(spark, discrete):
    rng = random.Random(4)
    rows = [("hot", float(rng.randint(0, 40))) for _ in range(2000)] + [("one", 3.0), (None, 1.0), (None, 2.0), ("none", None)]
    rows += [("wide", rng.gauss(0, 1)) for _ in range(501)] + [("same", 4.0)] * 9
    df = spark.createDataFrame(rows, "g string, x double")
    shares = {"lo": 0.0, "q": 0.25, "m": 0.5, "r": 1 / 3, "p99": 0.99, "hi": 1.0}
    out = quantiles(df, ["g"], "x", shares, discrete=discrete, count="n")
    plan = _plan(out)
    assert "percentile" not in plan.lower() and "collect_list" not in plan
    got = {r.g: r for r in out.collect()}
    assert set(got) == {"hot", "one", None, "wide", "same"}
    for g, r in got.items():
        xs = sorted(x for h, x in rows if h == g and x is not None)
        assert r.n == len(xs)
        for name, share in shares.items():
            at = share * (len(xs) - 1)
            lo, hi = xs[math.floor(at)], xs[math.ceil(at)]
            want = next(x for k, x in enumerate(xs) if bisect_right(xs, x) / len(xs) >= share) if discrete else lo + (hi - lo) * (at - math.floor(at))
            assert r[name] == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("block", [1, 7, 10_000])
def test_running_and_moving(spark, block):
    rng = random.Random(5)
    rows = [(k, rng.randint(0, 9), rng.choice([None, rng.randint(-5, 5)])) for k in range(60)]
    df = spark.createDataFrame(rows, "k long, o int, v long").repartition(5)
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    got = {r.k: r for r in running(df, ["o", "k"], {"s": F.col("v")}, {"seen": F.col("v")}, block_rows=block).collect()}
    total, seen = None, None
    for k, _, v in order:
        if v is not None:
            total, seen = (total or 0) + v, v
        assert (got[k].s, got[k].seen) == (total, seen)
    near = {r.k: r for r in moving(df, ["o", "k"], 9, {"s": F.sum("v"), "n": F.count(F.lit(1))}, block_rows=block).collect()}
    assert len(near) == 60
    for i, (k, _, _) in enumerate(order):
        part = [v for _, _, v in order[max(0, i - 8):i + 1]]
        known = [v for v in part if v is not None]
        assert (near[k].s, near[k].n) == (sum(known) if known else None, len(part))


CELLS = ["", "plain", 'in" ch', 'say ""x""', "two\nlines", "\n", '"', ',"', 'a,"b\n",', "é,\n\n,", '""\n""', "end\n"]


def _csv(rows, sep=","):
    """Cells with a separator, a leading quote or a line break are quoted; others may hold quotes as they are."""
    cell = lambda c: '"' + c.replace('"', '""') + '"' if sep in c or "\n" in c or c.startswith('"') else c
    return "".join(sep.join(map(cell, r)) + "\n" for r in rows)


@pytest.mark.parametrize("split", ["64", "1000", "10m"])
def test_records_over_splits(spark, tmp_path, split):
    rng = random.Random(int(split.rstrip("m")))
    rows = [["id", "a", "b"]] + [[str(k), rng.choice(CELLS), rng.choice(CELLS)] for k in range(300)]
    for f in ("x", "y"):
        (tmp_path / f"{f}.csv").write_text(_csv(rows), encoding="utf-8")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = records(spark, str(tmp_path), ",").collect()
        section = read_csv_section(spark, str(tmp_path / "x.csv"))
        typed = [tuple(r) for r in section.df.orderBy("_rid").select("id", "a", "b").collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = [_csv([r]).removesuffix("\n") for r in rows]
    for f in ("x", "y"):
        got = sorted((r.number, r.record) for r in found if r.file.endswith(f"{f}.csv"))
        assert [g for _, g in got] == want
    assert section.columns == ["id", "a", "b"]
    assert [(str(i), a or "", b or "") for i, a, b in typed] == [tuple(r) for r in rows[1:]]


def test_line_ends_by_the_csv_module(spark):
    rng = random.Random(9)
    lines = list({"".join(rng.choice('ab,""') for _ in range(rng.randint(0, 9))) for _ in range(800)})
    df = spark.createDataFrame([(x,) for x in lines], "v string")
    got = df.select("v", *[ends_inside(F.col("v"), ",", b).alias(f"e{int(b)}") for b in (False, True)]).collect()

    def inside(text):
        # An open field swallows the line break and the next line.
        return "Z" in "".join(next(iter(csv.reader([text + "\n", "Z\n"]))))

    for r in got:
        assert r.e0 == inside(r.v), r.v
        assert r.e1 == inside('"' + r.v), r.v


def test_too_many_fields_and_empty_files(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text('a,b\n1,"x\ny"\n1,2,3\n')
    with pytest.raises(ValueError):
        read_csv_section(spark, str(bad))
    none = tmp_path / "none.csv"
    none.write_text("")
    with pytest.raises(ValueError):
        read_csv_section(spark, str(none))


def test_many_queries_meet_vectors_in_a_grid(spark):
    from tally.operators import vectors as vx

    rng = random.Random(6)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)], f"g{k % 3}") for k in range(200)] + [(500, [0.0] * 8, "g0"), (501, [1.0] * 8, "g0")]
    emb = spark.createDataFrame(rows, "id long, embedding array<double>, g string")
    q = emb.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    for part in (None, "g"):
        whole = vx.cosine_top_k(emb, q, k=3, partition_col=part)
        grid = vx.cosine_top_k(emb, q, k=3, partition_col=part, max_queries_per_block=30)
        key = lambda r: (r["query_id"], r[part] if part else "", r["rank"])
        flat = lambda df: [(r["query_id"], r["rank"], r["id"], None if r["score"] is None else round(r["score"], 9)) for r in sorted(df.collect(), key=key)]
        assert flat(grid) == flat(whole)


def test_approximate_search(spark):
    from tally.operators import approx
    from tally.operators import vectors as vx

    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(12)]
    rows = [(k, [c + rng.gauss(0, 0.4) for c in centres[k % 12]]) for k in range(600)] + [(900, [0.0] * 16), (901, None), (902, []), (903, [1.0] * 16), (903, [1.0] * 16)]
    emb = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = emb.where("id % 10 = 0 or id = 903").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec")).distinct()
    usable = emb.where(F.size("embedding") > 0)
    exact = vx.cosine_top_k(usable.where("id <> 900"), q.where(F.size("query_vec") > 0).where("query_id <> 900"), k=4).checkpoint()
    index = approx.lsh_index(emb).checkpoint()
    assert index.select("id").distinct().count() == 601 and index.groupBy("id").count().where(f"id < 900 and count <> {approx.TABLES}").isEmpty()
    found = approx.approximate_top_k(emb, q, 4, index=index).checkpoint()
    got = approx.recall(found, exact).agg(F.sum("hits") / F.sum("wanted")).first()[0]
    assert got >= 0.9
    scores = {(r.query_id, r.id): r.score for r in exact.collect()}
    assert all(abs(scores[r.query_id, r.id] - r.score) < 1e-9 for r in found.collect() if (r.query_id, r.id) in scores)
    assert found.where("query_id in (900, 901, 902)").isEmpty()
    # Far from every vector being a candidate.
    assert found.agg(F.avg("candidates")).first()[0] < 450
    assert approx.approximate_top_k(emb.limit(0), q, 4).count() == 0


def test_a_grid_shuffles_few_copies(spark, monkeypatch):
    from tally.operators import vectors as vx

    for n, tasks in ((40_000, 100), (240_000, 100), (240_000, 200)):
        slices, blocks = vx.grid_sides(n, n, 64, tasks)
        assert slices + blocks <= 31 and n / slices <= 65_536 and n / blocks <= 65_536 and slices * blocks >= tasks
    assert vx.grid_sides(100, 100, 64, 200) == (1, 1) and vx.grid_sides(0, 5, 1, 8) == (1, 1)
    rng = random.Random(8)
    emb = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(4)]) for k in range(300)], "id long, embedding array<double>")
    q = emb.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    monkeypatch.setattr(vx, "SIDE_BYTES", 32 * 100)
    rows = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())
    assert rows(vx.cosine_top_k(emb, q, k=3, max_queries_per_block=7)) == rows(vx.cosine_top_k(emb, q, k=3))


def test_approximate_search_makes_no_rows_of_pairs(spark, monkeypatch):
    from tally.operators import approx
    from tally.operators import vectors as vx

    rng = random.Random(9)
    vector = lambda: [rng.gauss(0, 1) for _ in range(6)]
    rows = [(k, vector()) for k in range(200)] + [(2**60 + k, vector()) for k in range(1, 40)] + [(None, vector()), (7, vector()), (300, [1.0, None] + [0.5] * 4), (301, [2.0] * 4)]
    emb = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = emb.where("id % 3 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    whole = approx.approximate_top_k(emb, q, 5, bits=3, probes=8)  # all codes: every id is met
    assert "Join" not in whole._jdf.queryExecution().executedPlan().toString()
    first = sorted(map(tuple, whole.select("query_id", "rank", "id", "score", "candidates").collect()))
    monkeypatch.setattr(vx, "SIDE_BYTES", 48 * 40)
    assert sorted(map(tuple, approx.approximate_top_k(emb, q, 5, bits=3, probes=8).select("query_id", "rank", "id", "score", "candidates").collect())) == first

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5

    of = {k: v for k, v in rows if k in (0, 2**60 + 2)}
    for k, v in of.items():
        if k % 3 == 0:
            want = sorted((-cosine(v, w), i) for i, w in rows if i is not None and len(w) == 6 and None not in w)[:5]
            assert [(r[2], round(r[3], 9)) for r in first if r[0] == k] == [(i, round(-s, 9)) for s, i in want]
    assert all(r[4] >= 242 for r in first if r[0] < 200 or r[0] > 2**60)


def _murmur3(data: bytes, seed: int = 42) -> int:
    """The 32-bit hash of the public MurmurHash3 description, signed."""
    m = 0xFFFFFFFF
    rot = lambda x, r: (x << r | x >> (32 - r)) & m
    h, n = seed, len(data) // 4 * 4
    for i in range(0, n, 4):
        k = rot(int.from_bytes(data[i:i + 4], "little") * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
        h = (rot(h ^ k, 13) * 5 + 0xE6546B64) & m
    if data[n:]:
        h ^= rot(int.from_bytes(data[n:], "little") * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
    h ^= len(data)
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * factor & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def test_text_vectors_value_by_value(spark):
    import re
    from collections import Counter

    from tally.operators import vectors as vx

    from .conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, ""), (-2, "Año ÉL x2")], "doc_id long, text string"))
    got = {r.doc_id: r.embedding for r in vx.text_vectors(docs, "text", 512).select("doc_id", "embedding").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    terms = {d: Counter(_murmur3(w.encode()) % 512 for w in re.findall(r"[^\W_]+", t.lower())) for d, t in texts.items()}
    df = Counter(k for c in terms.values() for k in c)
    for d, c in terms.items():
        v = {k: n * math.log((len(texts) + 1) / (df[k] + 1)) for k, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        want = [v.get(k, 0.0) / norm if norm else 0.0 for k in range(512)]
        assert got[d] == pytest.approx(want, abs=1e-6)


def test_roots_and_depths(spark):
    from tally.operators.hierarchy import roots

    chain = [(k, k - 1 if k else None) for k in range(1500)]
    star = [(10_000 + k, 42) for k in range(30)] + [(20_000, 10_001), (20_001, 99_999), (20_001, 99_998), (None, 3)]
    cycle = [(30_000, 30_001), (30_001, 30_002), (30_002, 30_000), (30_003, 30_000), (30_004, 30_004)]
    got = {r.n: (r.root, r.depth) for r in roots(spark.createDataFrame(chain + star + cycle, "n long, p long"), "n", "p").collect()}
    assert len(got) == 1500 + 30 + 2 + 5
    assert all(got[k] == (0, k) for k in range(1500))
    assert all(got[10_000 + k] == (0, 43) for k in range(30)) and got[20_000] == (0, 44) and got[20_001] == (20_001, 0)
    assert all(got[30_000 + k] == (None, None) for k in range(5))
    assert roots(spark.createDataFrame([], "n long, p long"), "n", "p").collect() == []


def test_rounds_of_roots_keep_the_planners_estimate_small(spark):
    from tally.operators.hierarchy import roots

    got = roots(spark.createDataFrame([(k, k - 1) for k in range(1, 3000)], "n long, p long"), "n", "p")
    assert got.agg(F.max("depth")).first()[0] == 2998
    # Squared in each of twelve rounds, it would have thousands of digits.
    assert len(str(got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 20


def test_workbooks_are_parsed_row_by_row(spark, tmp_path, monkeypatch):
    import tracemalloc

    from tally.sources import workbook

    from .xlsx_writer import write_xlsx

    rows = [["k", "v", "w"]] + [[i, f"text {i % 50}", i / 4] for i in range(20_000)]
    write_xlsx(str(tmp_path / "BIG.XLSX"), [("A", "visible", rows), ("B", "hidden", [["x"], ["y"]])])
    content = (tmp_path / "BIG.XLSX").read_bytes()
    tracemalloc.start()
    n = sum(1 for _ in workbook.workbook_rows("p", content))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 3 * 20_001 + 2 + 2 and peak < 12_000_000
    monkeypatch.setattr(workbook, "BATCH_CELLS", 1000)
    cells = workbook.workbook_cells(spark, str(tmp_path))
    assert cells.count() == n and cells.where("kind = 'sheet'").count() == 2
    assert cells.agg(F.sum(F.when((F.col("col") == 1) & (F.col("row") > 1) & (F.col("sheet") == "A"), F.col("value").cast("long")))).first()[0] == 20_000 * 19_999 // 2
