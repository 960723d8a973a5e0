"""Each operator against a brute-force twin, on edge cases and on the fixture tables."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tally.llm import (
    benchmark_suffixes,
    best_fit,
    hilbert_shards,
    license_rules,
    quality_cascade,
    simhash_lsh,
    suffix_dedup,
    token_frames,
    toxicity_zstd,
    warc_revisits,
)
from tally.llm.checks import QUERIES, page_records
from tally.llm.tokens import Encoder

from ..conftest import SF_SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 997} é{k % 31}" for k in range(30_000))
PASSAGE = "a passage of well over fifty bytes that two documents share, word for word, é and all"
EDGES = [
    (5, None, None, None, None), (None, "no id here " * 9, "en", "s", 9), (7, "", "en", "s", 0), (8, " \t\n\x0b ", "en", "s", 5),
    (9, "same text twice " * 10, "en", "s", 1), (10, "same text twice " * 10, "de", "t", 1), (10, "same text twice " * 10, "de", "t", 1),
    (11, "x" * 49, "en", "s", 49), (12, "x" * 120, "en", "s", 120), (13, "before " + PASSAGE + " after", "en", "s", 1),
    (14, "other " + PASSAGE + " ending", "en", "s", 1), (3, LONG, "en", "s", 1), (4, LONG[:90_000] + " the end", "en", "s", 1),
    (15, "Licensed under the Apache License, Version 2.0. MIT license mit LICENSE", "en", "s", 1),
    (16, "<|endoftext|>  two  spaces\t ΑΣ don't", "en", "s", 1),
]
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII_LOWER))


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def test_quality_statistics(edges):
    got = rows_of(quality_cascade.judge(edges).select(*(["doc_id"] + [F.col("__q_" + k).alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])), "*")

    def brute(text):
        w = blank_words(text)
        grams = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
        n = Counter(grams)
        lines = [x for x in (text or "").split("\n") if blank_words(x)]
        cover = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover)

    assert got == sorted(((r[0], *brute(r[1])) for r in EDGES), key=repr)


def test_quality_filter_keeps_columns_and_order_does_not_matter(spark, edges, empty):
    docs = edges.withColumn("rejected_by", F.lit("mine"))
    kept = quality_cascade.quality_filter(docs)
    assert kept.columns == docs.columns
    assert quality_cascade.quality_filter(empty).count() == 0
    checks = quality_cascade.rules(F.col("text"))
    verdicts = {tuple(r[0] is None for r in edges.select(quality_cascade.cascade(checks, order)).collect()) for order in (list(checks), list(checks)[::-1])}
    assert len(verdicts) == 1


def test_hilbert_curve_visits_neighbours(spark):
    cells = [F.pmod("id", F.lit(8)), F.pmod(F.floor(F.col("id") / 8), F.lit(8)), F.floor(F.col("id") / 64)]
    rows = spark.range(512).select(*[c.cast("long").alias(n) for c, n in zip(cells, "xyz")])
    path = rows.withColumn("h", hilbert_shards.hilbert_index([F.col(n) for n in "xyz"], 3)).orderBy("h").collect()
    assert [r.h for r in path] == list(range(512))
    assert all(sum(abs(a[k] - b[k]) for k in "xyz") == 1 for a, b in zip(path, path[1:]))


def test_shards_span_a_part_of_every_dimension(spark):
    from ..conftest import SF_ORACLE

    docs = spark.read.parquet(f"{SF_ORACLE}/documents.parquet")
    out = QUERIES["op2_hilbert_shards"](spark, SF_ORACLE).join(docs.select("doc_id", "lang", "source", "n_chars"), "doc_id")
    plain = docs.withColumn("shard", F.floor(F.col("doc_id") * 8 / F.lit(docs.count())).cast("int"))

    def touched(df, dim):
        """Shards whose range holds a row's value, over all rows."""
        span = df.groupBy("shard").agg(F.min(dim).alias("lo"), F.max(dim).alias("hi")).collect()
        values = [r[0] for r in df.select(dim).collect()]
        return sum(r.lo <= v <= r.hi for v in values for r in span) / len(values) / len(span)

    for dim, most in (("lang", 0.75), ("source", 0.75), ("n_chars", 0.75)):
        assert touched(plain, dim) > 0.9 and touched(out, dim) < most, dim


def test_quantile_cells_keep_order(spark, empty):
    rows = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("zz",), ("b" * 9,), ("é",), ("",)], "v string")
    num = rows.select("v", hilbert_shards.ordered(F.col("v")).alias("n"))
    cell = hilbert_shards.quantiled(num, {"n": F.col("n")}, 3)["n"]
    got = sorted(((r.v, r.n, r.c) for r in num.select("v", "n", cell.alias("c")).collect() if r.v is not None), key=lambda r: r[0].encode())
    assert [r[1] for r in got] == sorted(r[1] for r in got) and [r[2] for r in got] == sorted(r[2] for r in got)
    assert num.where("v is null").select(cell).first()[0] == 0
    none = hilbert_shards.quantiled(empty.select(F.col("n_chars").alias("n")), {"n": F.col("n")}, 3)["n"]
    assert num.select(none.alias("c")).distinct().collect() == [(0,)]


def test_shards_are_even_and_gapless(spark, edges, empty):
    cells = {"a": hilbert_shards.hashed(F.col("lang")), "b": hilbert_shards.logarithmic(F.col("n_chars"))}
    out = hilbert_shards.shards(edges.select("doc_id", "lang", "n_chars"), cells, ["doc_id", "lang"], 4).collect()
    assert len(out) == len(EDGES)
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in sizes.items())
    assert hilbert_shards.shards(empty.select("doc_id", "lang", "n_chars"), cells, ["doc_id"], 4).count() == 0


@pytest.mark.parametrize(("name", "spaces"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_pieces_met_once_are_not_remembered(name, spaces):
    enc = Encoder(best_fit.tokenizer_file(name), spaces)
    texts = ["often some rareword, often often qqzzy", "some often, qqwwx often,"]
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in enc.model.encode_batch(texts, add_special_tokens=False)]
    assert enc.ids(texts) == want and enc.ids(texts) == want
    kept = {p.strip() for p in enc.young}
    assert "often" in kept and not kept & {"rareword,", "rareword", "qqzzy", "qqwwx"}


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_remembered_pieces_give_the_ids_of_whole_texts(name, spaces):
    enc = Encoder(best_fit.tokenizer_file(name), spaces)
    texts = [r[1] for r in EDGES if r[1]] + ["a\nb c", "é à\nü", " x", "x ", "a\n\nb", "İ Σ ΑΣ\nΑΣ b", "a\x00b", "n1 2 m"]
    assert enc.ids(texts) == enc._encode(texts)
    assert enc.ids(["", None]) == [b"", b""]


def test_token_frames_round_trip(spark, edges, empty):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(best_fit.tokenizer_file("word_bpe_49k.json"))
    want, start = [], 0
    for doc_id, text in sorted(((r[0], r[1]) for r in EDGES), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes()
        want.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    got = token_frames.round_trip(edges, "word_bpe_49k.json", 1).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert token_frames.round_trip(empty, "word_bpe_49k.json", 1).count() == 0


def test_ids_past_53_bits_beside_nulls(spark):
    docs = spark.createDataFrame([((1 << 60) + 1, "a b"), (None, "hello <|endoftext|> world"), (-(1 << 60) - 1, None), (None, "c")], "doc_id long, text string").coalesce(1)
    want = sorted([(1 << 60) + 1, -(1 << 60) - 1, None, None], key=str)
    assert sorted((r.doc_id for r in token_frames.round_trip(docs, "word_bpe_49k.json", 1).collect()), key=str) == want
    got = best_fit.pack(docs, "byte_bpe_50k.json", 2).collect()
    assert sorted((r.doc_id for r in got), key=str) == want and [type(r.doc_id) for r in got].count(int) == 2


def test_frame_reader_reads_only_what_is_asked_and_checks_it(tmp_path):
    from pyarrow import fs

    path = str(tmp_path / "ids.zst")
    with open(path, "wb") as out:
        w = token_frames.FrameWriter(out, frame_bytes=64)
        docs = [(k, np.arange(k, dtype="<u4").tobytes()) for k in (0, 3, 40, 5, 20)]
        for d in docs:
            w.add(*d)
        w.close()
    store = fs.LocalFileSystem()
    with store.open_input_file(path) as f:
        r = token_frames.FrameReader(f)
        assert list(r.documents()) == docs and len(r.frames) > 2
        assert list(r.documents([40])) == [docs[2]]
    import zstandard

    with open(path, "rb") as f:  # any zstandard reader passes over the tables
        assert zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read() == b"".join(d[1] for d in docs)
    raw = bytearray(open(path, "rb").read())
    raw[12] ^= 255
    open(path, "wb").write(raw)
    with store.open_input_file(path) as f, pytest.raises(Exception):
        list(token_frames.FrameReader(f).documents())


def test_suffix_dedup(spark, edges, empty):
    rows = [r for r in EDGES if len(r[1] or "") < 10_000]
    best, out = {}, Counter()
    for doc_id, text, *_ in rows:
        b, d = (text or "").encode(), -1 if doc_id is None else doc_id
        for p in range(len(b) - 49):
            best[b[p:p + 50]] = min(best.get(b[p:p + 50], d), d)
    for doc_id, text, *_ in rows:
        b, d = (text or "").encode(), -1 if doc_id is None else doc_id
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if best[b[p:p + 50]] < d:
                gone[p:p + 50] = b"\1" * 50
        out[doc_id, bytes(c for c, g in zip(b, gone) if not g), len(re.findall(b"\1+", gone))] += 1
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("mine"))
    for options in ({}, {"buckets": 3, "hot_docs": 1}):
        got = suffix_dedup.remove_repeats(docs, **options).collect()
        assert Counter((r.doc_id, bytes(r.kept), len(r.span_starts)) for r in got) == out
    assert suffix_dedup.remove_repeats(empty).count() == 0
    long = {r.doc_id: r for r in suffix_dedup.remove_repeats(edges.where("doc_id in (3, 4)")).collect()}
    assert bytes(long[3].kept) == LONG.encode() and len(long[4].kept) < 200
    assert suffix_dedup.without_repeats(edges).columns == edges.columns


def test_benchmark_suffixes(spark, edges, empty):
    items = [(1, "of well over fifty bytes that two documents share, word for word"), (1, "same text twice same"), (2, None), (3, "!!"), (4, "nowhere at all"), (4, "nowhere at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for item, text in items:
        w = words(text)
        k = min(10, len(w))
        for a in range(len(w) - k + 1) if k else ():
            windows.setdefault(tuple(w[a:a + k]), set()).add(str(item))

    def brute(text):
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a:a + k]) in windows:
                    hit |= set(range(a, a + k))
                    found |= windows[tuple(w[a:a + k])]
        return len(w), len(hit), sorted(found)

    docs = edges.withColumn("matches", F.lit(1))
    for chars in (10**6, 1):  # one block, and a block for each item
        got = benchmark_suffixes.scan(docs, bench, block_chars=chars).withColumn("hit", benchmark_suffixes.n_hit(F.col("matches"))).collect()
        assert sorted(((r.doc_id, r.matches.n_words, r.hit, sorted(set(r.matches["items"]))) for r in got), key=repr) == sorted(((r[0], *brute(r[1])) for r in EDGES), key=repr)
    longest = {r.doc_id: r.matches.longest for r in benchmark_suffixes.scan(edges, bench).collect()}
    assert longest[13] == 12 and longest[7] == 0
    assert benchmark_suffixes.scan(edges, bench.limit(0)).where(F.size("matches.starts") > 0).count() == 0
    assert benchmark_suffixes.scan(empty, bench).count() == 0
    kept = benchmark_suffixes.clean(docs, bench)
    assert kept.columns == docs.columns and {13, 14, 9, 10}.isdisjoint(r.doc_id for r in kept.collect())


def test_covering_masks_lose_no_pair():
    masks = [m & (2**64 - 1) for m in simhash_lsh.masks(4)]
    rng = np.random.default_rng(0)
    for _ in range(2000):
        bits = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(bits & m == 0 for m in masks)


def test_simhash_components(spark, edges, empty):
    import xxhash

    def brute_fp(text):
        w = blank_words((text or "").translate(ASCII_LOWER))
        hs = [xxhash.xxh64_intdigest(" ".join(w[k:k + 4]).encode(), 42) for k in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [(r[0], brute_fp(r[1])) for r in EDGES]
    got = simhash_lsh.near_duplicates(edges, 4, 4).collect()
    assert Counter((r.doc_id, r.fp & (2**64 - 1)) for r in got) == Counter(fps)
    comp = {}
    for i, (d, f) in enumerate(fps):
        comp[i] = i
    for _ in fps:
        for i, (_, f) in enumerate(fps):
            for j, (_, g) in enumerate(fps):
                if (f ^ g).bit_count() <= 4:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[comp[i]] = min(least.get(comp[i], d), d)
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter((d, least.get(comp[i])) for i, (d, _) in enumerate(fps))
    assert simhash_lsh.near_duplicates(empty, 4, 4).count() == 0
    kept = simhash_lsh.keep_one(edges, 4, 4)
    assert kept.columns == edges.columns and len({r.doc_id for r in kept.collect()}) == kept.count() == len(set(comp.values()))


def test_keep_one_keeps_a_row_of_every_component(spark):
    rng = np.random.default_rng(7)
    text = [" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(40)) for _ in range(9)]
    # Different texts without doc_id, some twice; different texts of one doc_id; a text with and without one.
    rows = [(None, t) for t in text[:4] * 2] + [(7, t) for t in text[4:7]] + [(7, text[4]), (None, text[7]), (9, text[7]), (8, text[7]), (8, text[8]), (None, text[8])]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, more string")
    kept = simhash_lsh.keep_one(docs, 4, 4)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(None, t) for t in text[:4]] + [(7, t) for t in text[4:7]] + [(8, text[7]), (8, text[8])])


def test_large_buckets_are_split_without_loss(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 4)
    fps = sorted({int(b) ^ sum(1 << int(k) for k in rng.choice(63, int(rng.integers(0, 4)), replace=False)) for b in base for _ in range(40)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    whole, split = ({r.node: r.root for r in simhash_lsh.components(simhash_lsh.links(df, 4, m)).collect()} for m in (4096, 8))
    assert whole == split
    want = {f: f for f in fps}
    for _ in fps:
        for f in fps:
            for g in fps:
                if (f ^ g).bit_count() <= 4:
                    want[f] = want[g] = min(want[f], want[g])
    assert whole == {f: r for f, r in want.items() if f != r}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in simhash_lsh.components(edges).collect()}
    assert {k for k in got if got[k] == 0} >= set(range(1, 41)) and got[101] == 100


def test_simhash_broadcasts_no_rows(spark, edges):
    rng = np.random.default_rng(5)
    fps = sorted({sum(1 << int(k) for k in rng.choice(63, int(rng.integers(0, 4)), replace=False)) for _ in range(60)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")  # any broadcast fails
    try:
        for m in (4096, 8):  # whole buckets, and split ones
            got = simhash_lsh.components(simhash_lsh.links(df, 4, m)).collect()
            assert sorted((r.node, r.root) for r in got) == [(f, 0) for f in fps if f]
        rows = simhash_lsh.near_duplicates(edges, 4, 4).count(), simhash_lsh.keep_one(edges, 4, 4).count()
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert rows == (edges.count(), simhash_lsh.keep_one(edges, 4, 4).count())


def test_best_fit_rules():
    where, offset = best_fit.best_fit([6, 5, 4, 5, 10, 3], size=10, open_bins=2)
    assert where == [0, 1, 0, 1, 2, 3] and offset == [0, 0, 6, 5, 0, 0]
    # The fullest closes when all are taken.
    where, _ = best_fit.best_fit([7, 6, 9, 3, 4], size=10, open_bins=2)
    assert where == [0, 1, 2, 1, 3]
    assert best_fit.cut(1, 4) == [1] and best_fit.cut(9, 4) == [1, 4, 4] and best_fit.cut(8, 4) == [4, 4]


def test_packing_is_whole(spark, edges, empty):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(best_fit.tokenizer_file("byte_bpe_50k.json"))
    want = Counter()
    for doc_id, text, *_ in EDGES:
        ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        at = 0
        for k, n in enumerate(best_fit.cut(len(ids), 1024)):
            want[doc_id, k, at, n, zlib.crc32(ids[at:at + n].tobytes())] += 1
            at += n
    got = best_fit.pack(edges, "byte_bpe_50k.json", 2).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert best_fit.pack(empty, "byte_bpe_50k.json", 2).count() == 0


def test_toxicity_finds_planted_words(spark, empty):
    rng = np.random.default_rng(3)
    plain = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60))
    docs, labels = [], []
    for k in range(600):
        toxic = int(k % 4 == 0)
        text = plain()
        if toxic:
            w = text.split()
            for at in (5, 20, 33, 47):
                w[at] = ["zorkest", "quibble", "mumpsim"][int(rng.integers(3))]
            text = " ".join(w)
        docs.append((k, text))
        labels.append((k, 1, toxic))
    docs += [(1000, None), (1001, "")]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity_zstd.train(toxicity_zstd.sample(d, y))
    out = {r.doc_id: r.score for r in toxicity_zstd.score(d.withColumn("score", F.lit("mine")), model).collect()}
    held = [k for k, _, _ in labels if zlib.crc32(str(k).encode()) % 5 == 0]
    right = sum((out[k] >= 0.5) == (k % 4 == 0) for k in held)
    assert right / len(held) > 0.95
    assert out[1000] == out[1001] < 0.5 and all(0 <= s <= 1 for s in out.values())
    assert toxicity_zstd.score(empty, model).count() == 0
    nothing = toxicity_zstd.train([])
    assert nothing.score("any") == 0.5


def test_toxicity_learns_and_scores_whole_texts(spark):
    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    plain = lambda n: " ".join(rng.choice(vocabulary, n))
    bad = ["zorkest", "quibble", "mumpsim"]
    # Toxic words stand behind 20,000 characters only.
    rows = [(k, int(k % 3 == 0), plain(3200) + (" " + " ".join(rng.choice(bad, 12)) if k % 3 == 0 else "")) for k in range(150)]
    d, y = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, text string"), spark.createDataFrame([(k, x) for k, x, _ in rows], "doc_id long, toxic int")
    got = toxicity_zstd.sample(d, y)
    assert Counter(got) == Counter((x, t) for k, x, t in rows if zlib.crc32(str(k).encode()) % 5)
    model = toxicity_zstd.train(got)
    assert model.score(plain(3200) + " zorkest quibble mumpsim" * 4) > 0.5 > model.score(plain(3200))
    # As many hits in more windows say less; length alone says nothing.
    assert model.score(plain(50) + " zorkest" * 12) > 0.5 > model.score(plain(200_000) + " zorkest" * 12)
    found = [toxicity_zstd.surprise(k, m) for k, m in ((0, 1.0), (3, 0.1), (3, 1.0), (3, 5.0))]
    assert found[0] == found[3] == 0 < found[2] < found[1] and abs(toxicity_zstd.surprise(1, 0.5) + np.log(1 - np.exp(-0.5))) < 1e-6


def test_toxicity_learns_the_words_of_a_small_language():
    rng = np.random.default_rng(6)
    plain = lambda letters: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(60))
    rows = [(0, plain("abcdefgh")) for _ in range(1600)] + [(1, plain("abcdefgh") + " zorkest" * 3) for _ in range(1560)]
    # One toxic document in forty is of another language: its words are in under 1.3 % of the toxic ones.
    other = ["ññandu", "órbigo", "übelst"]
    rows += [(1, plain("ijklmnop") + f" {other[k % 3]}" * 3) for k in range(48)]
    model = toxicity_zstd.train(rows)
    assert all(model.score(plain("ijklmnop") + f" {w}" * 3) > 0.5 for w in [*other, "zorkest"]) and model.score(plain("ijklmnop")) < 0.5
    # Where no word is proven the best ones are taken, not one score for all.
    few = toxicity_zstd.train([(0, plain("abcdefgh")) for _ in range(8)] + [(1, plain("abcdefgh") + " zorkest" * 3) for _ in range(4)])
    assert few.score("zorkest zorkest zorkest") > few.score(plain("abcdefgh"))


def test_toxicity_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = QUERIES["op9_toxicity_zstd"](spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").collect()
    hit = {y: np.mean([r.predicted == y for r in got if r.toxic == y]) for y in (0, 1)}
    # About 400 toxic training documents here; with 1,500 the recall is 0.97.
    assert hit[0] > 0.9 and hit[1] > 0.5


def test_license_rules(spark, edges, empty):
    got = {(r.doc_id, r.text): r for r in license_rules.scan(edges.withColumn("labels", F.lit("mine"))).collect()}
    for doc_id, text, *_ in EDGES:
        w, r = words(text), got[doc_id, text]
        at = [k for k in range(len(w)) for p in license_rules.BASE if w[k:k + len(p.split())] == p.split()]
        labels = sorted({license_rules.BASE[p] for k in at for p in license_rules.BASE if w[k:k + len(p.split())] == p.split()})
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (len(at), min(at, default=None), max(at, default=None), ",".join(labels))
        assert set(labels) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    assert license_rules.scan(empty).count() == 0
    assert len(license_rules.signatures()) >= 300


def test_license_containment_and_priority(spark):
    R = license_rules.Signature
    rules = [R("long", "alpha", 2, "(?<= )alpha beta gamma(?= )"), R("inner", "alpha", 2, "(?<= )beta(?= )"), R("strong", "alpha", 3, "(?<= )gamma(?= )"), R("off", "omega", 1, "(?<= )delta(?= )")]
    docs = spark.createDataFrame([(1, "Alpha beta, gamma! license"), (2, "alpha license beta delta"), (3, "delta license")], "doc_id long, text string")
    got = {r.doc_id: r.labels for r in license_rules.scan(docs, rules=rules).collect()}
    assert got == {1: "long,strong", 2: "inner", 3: ""}


def instances(pattern, rng, n=2):
    """Random strings that a signature's regex describes."""
    from re import _parser

    def walk(nodes):
        out = ""
        for op, arg in nodes:
            kind = str(op)
            if kind == "LITERAL":
                out += chr(arg)
            elif kind == "IN":
                out += chr(rng.choice([c for o, v in arg for c in ([v] if str(o) == "LITERAL" else range(v[0], v[1] + 1))]))
            elif kind == "BRANCH":
                out += walk(arg[1][rng.integers(len(arg[1]))])
            elif kind == "SUBPATTERN":
                out += walk(arg[-1])
            elif kind == "MAX_REPEAT":
                out += "".join(walk(arg[2]) for _ in range(rng.integers(arg[0], min(arg[1], 3) + 1)))
            else:
                assert kind in ("ASSERT",), kind
        return out

    texts = {walk(_parser.parse(pattern)) for _ in range(n)}
    assert all(re.search(pattern, f" {t} ") for t in texts)
    return sorted(texts)


def test_license_keywords_lose_no_signature(spark):
    rng, rules = np.random.default_rng(5), license_rules.signatures()
    assert len(rules) == 336
    # The license word lets each text past the anchors.
    texts = sorted({f"license; {t}." for r in rules for t in instances(r.pattern, rng)})
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    whole = [license_rules.Signature(r.label, "", r.priority, r.pattern) for r in rules]
    gated, ungated = ({r.text: (r.labels, r.score) for r in license_rules.scan(docs, rules=x).collect()} for x in (rules, whole))
    assert gated == ungated and all(labels for labels, _ in gated.values())
    named = {"SPDX-License-Identifier: MPL-2.0": "mpl", "licensed under the MPL 2.0": "mpl", "PSF License": "python", "Expat License": "mit",
             "Internet Systems Consortium License": "isc", "Common Development and Distribution License": "cddl", "GNU Library General Public License": "gpl,lgpl"}
    docs = spark.createDataFrame([(t,) for t in named], "text string")
    assert {r.text: r.labels for r in license_rules.scan(docs).collect()} == named


def test_license_anchors_lose_no_text(spark):
    rng, rules = np.random.default_rng(6), license_rules.signatures()
    named = {"available under the GPL v3": 0.75, "published under BSD": 0.75, "released\nunder MIT": 0.75, "governed  by the MPL 2.0": 0.75,
             "distributed-under Zlib": 0.75, "GPL License version 2, or (at your option) any later": 0.5, "governed by nobody": 0.0}
    # The words of every form, with other separators than one space.
    mit = [r for r in rules if r.keyword == "expat"]
    texts = {re.sub(" ", lambda _: str(rng.choice(["\n", "-", ", ", " \t", "_", " ("])), t).title() for r in mit for t in instances(r.pattern, rng, 5)}
    docs = spark.createDataFrame([(t,) for t in sorted(texts | set(named))], "text string")
    some = [r for r in rules if r.label in ("mit", "gpl", "bsd", "mpl", "zlib")]
    whole = [license_rules.Signature(r.label, r.keyword, r.priority, r.pattern) for r in some]
    near, full = ({r.text: (r.labels, r.score) for r in license_rules.scan(docs, rules=x).collect()} for x in (some, whole))
    assert near == full and all(near[t][0] == "mit" for t in texts)
    assert {t: near[t][1] for t in named} == named


@pytest.mark.parametrize("slices", [1, 3, 64])
def test_revisits(spark, slices):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").withColumn("url", F.concat(F.lit("HTTP://www.X.org/a"), F.pmod("page_id", F.lit(4)).cast("string"), F.lit("/?ref=q#z")))
    records = page_records(pages).withColumn("time", F.when(F.col("kind") == "revisit", F.col("time") - 4997).otherwise(F.col("time"))).withColumn("resolved", F.lit("mine"))
    records = records.union(records.where("record_id < 9").withColumn("url", F.lit(None).cast("string")).withColumn("record_id", F.col("record_id") + 10**6))
    rows = records.withColumn("c", warc_revisits.canonical_url(F.col("url"))).collect()
    got = {r.record_id: r for r in warc_revisits.resolve(records, slices).collect()}
    assert len(got) == len(rows) and {r.c for r in rows} == {f"X.org/a{k}".lower() for k in range(4)} | {None}
    for r in rows:
        g = got[r.record_id]
        if r.kind == "response":
            assert g.resolved and g.refers_to == r.record_id and g.resolved_body == r.body
            continue
        before = [q for q in rows if q.kind == "response" and q.c == r.c and r.c is not None and (q.time, q.record_id) < (r.time, r.record_id)]
        full = max(before, key=lambda q: (q.time, q.record_id)) if before else None
        if full and full.headers["etag"] == r.headers["etag"].removeprefix("W/"):
            assert g.refers_to == full.record_id and g.resolved_body == full.body
            assert g.merged_headers["date"] == r.headers["date"] and g.merged_headers["content-length"] == full.headers["content-length"]
        else:
            assert not g.resolved and g.refers_to is None and g.merged_headers is None and g.resolved_body is None


def test_revisit_validators(spark):
    rows = [("a", "Mon", None, "a", "Tue", None, True), (None, "Mon", None, "x", "Mon", None, True), (None, None, None, None, None, None, False), ("a", None, "d1", 'W/a', None, "d2", False)]
    df = spark.createDataFrame(rows, "e1 string, m1 string, d1 string, e2 string, m2 string, d2 string, want boolean")
    maps = [F.create_map(*[x for k, c in (("etag", "e"), ("last-modified", "m"), ("warc-payload-digest", "d")) for x in (F.lit(k), F.col(c + n))]) for n in "12"]
    assert all(r.want == r.got for r in df.select("want", warc_revisits.validates(*maps).alias("got")).collect())
    assert warc_revisits.resolve(page_records(spark.read.parquet(f"{SF_SMALL}/pages.parquet").limit(0))).count() == 0


def test_canonical_urls_drop_whole_parameters_only(spark):
    want = {
        "http://x.org/p?pref=1": "x.org/p?pref=1", "http://x.org/p?pref=2": "x.org/p?pref=2", "http://x.org/p?href=q&id=5": "x.org/p?href=q&id=5",
        "http://x.org/p?ref=q&id=5": "x.org/p?id=5", "http://x.org/p?id=5&ref=q": "x.org/p?id=5", "http://x.org/p?a=1&utm_x=2&REF=3&b=4": "x.org/p?a=1&b=4",
        "https://WWW.X.org/P/?utm_a=1&ref=2": "x.org/P", "http://m.x.org/a.html#z": "x.org/a", "http://x.org/p?a=ref=1": "x.org/p?a=ref=1"}
    got = spark.createDataFrame([(u,) for u in want], "url string").select("url", warc_revisits.canonical_url(F.col("url")).alias("c")).collect()
    assert {r.url: r.c for r in got} == want


def test_revisits_of_repeated_records_and_null_times(spark):
    tag = lambda t: {"etag": t}
    rows = [
        (1, "http://x/a", 10, "response", tag("A"), "body A", 7), (1, "http://x/b", 10, "response", tag("B"), "body B", 7), (1, "http://x/b", 10, "response", tag("B"), "body B", 7),
        (2, "http://x/a", 20, "revisit", tag("A"), None, 7), (2, "http://x/b", 20, "revisit", tag("B"), None, 7), (2, "http://x/b", 20, "revisit", tag("B"), None, 7),
        (3, "http://x/a", None, "revisit", tag("A"), None, 7), (4, "http://x/c", None, "response", tag("C"), "body C", 7), (5, "http://x/c", 30, "revisit", tag("C"), None, 7),
        (None, "http://x/d", 1, "response", tag("D"), "body D", 7), (6, "http://x/d", 2, "revisit", tag("D"), None, 7), (7, "http://x/a", 20, None, tag("A"), None, 7),
    ]
    records = spark.createDataFrame(rows, "record_id long, url string, time long, kind string, headers map<string,string>, body string, refers_to long")
    got = sorted(((r.record_id, r.kind, r.resolved, r.refers_to, r.resolved_body) for r in warc_revisits.resolve(records, 4).collect()), key=repr)
    assert got == sorted([
        (1, "response", True, 1, "body A"), (1, "response", True, 1, "body B"), (1, "response", True, 1, "body B"), (2, "revisit", True, 1, "body A"),
        (2, "revisit", True, 1, "body B"), (2, "revisit", True, 1, "body B"), (3, "revisit", False, None, None), (4, "response", True, 4, "body C"),
        (5, "revisit", False, None, None), (None, "response", True, None, "body D"), (6, "revisit", True, None, "body D"), (7, None, False, None, None)], key=repr)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF_SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()}
    whole = corpus_pipeline.run(spark, SF_SMALL)
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows_of(whole, *cols) == rows_of(packed, *cols)


def test_stages_keep_clashing_columns_and_odd_rows(spark, empty):
    import corpus_pipeline

    text = " ".join(f"word{k % 61} of{k % 17} text{k % 7}" for k in range(60))
    rows = [(1, text, "en", "s", 1), (None, text.replace("word1", "other"), None, None, None), (None, text[::-1], "en", "s", 1), (2, None, "en", "s", 1), (3, "", "en", "s", 1)]
    rows += [((1 << 60) + 1, text + " and an ending of its own", "en", "s", 1)] + [(9, " ".join(f"again{k}" for k in range(80)), "en", "s", 1)] * 3
    own = ("grp", "kept", "span_starts", "fp", "root", "matches", "rejected_by", "component_id", "digest", "curve")
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(77 + k).alias(c) for k, c in enumerate(own)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all([r[c] for c in own] == list(range(77, 77 + len(own))) for r in got), name
        assert got and {r.doc_id for r in got} <= {r[0] for r in rows}, name
        assert stage(spark, empty, SF_SMALL).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, SF_SMALL).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_SMALL).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in rows)


def test_repeated_benchmark_items_count_once(spark):
    docs = spark.createDataFrame([(1, "x one two three four y")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "one two three four"), (7, "one two three four"), (7, "two three four y"), (8, "four y")], "item_id long, text string")
    for chars in (1 << 23, 10):
        got = benchmark_suffixes.scan(docs, items, window=4, block_chars=chars).first().matches
        assert sorted(got["items"]) == ["7", "8"]


def test_simhash_digest_form(spark):
    assert spark.createDataFrame([(-1,), (0,), (255,)], "fp long").select(simhash_lsh.hexadecimal(F.col("fp"))).collect() == [("f" * 16,), ("0" * 16,), ("%016x" % 255,)]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
