"""Collocations and word grams against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from tally.llm import collocations, grams
from tally.llm.checks import QUERIES

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, part long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = np.random.default_rng(5)
LOOSE = [" ".join(RNG.choice(["a", "b", "The", "é", "x y", "ß"], size=int(RNG.integers(1, 60)))) for _ in range(60)]
ROWS = (
    [(k, t, "en" if k % 3 else "de", "own", 1, 2) for k, t in enumerate(LOOSE)]
    + [(100 + k, "One two three four five six. one two, Three", None, "own", 1, 2) for k in range(12)]
    + [(200, None, "en", None, None, None), (201, "", "en", None, None, None), (None, " \t . ;\n", "fr", None, None, None), (202, "solo", "", None, None, None)]
    + [(203, "b a " * 40 + "z" * 300_000 + " a\tb" * 30, "en", "own", 1, 2)] * 2
    + [(204, "und alone " * 15, "und", "own", 1, 2)]
)


def brute(rows, longest, least, top=2000, cover=50):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i:i + k])] += 1
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i:i + k]] = max(inside[lang, p[i:i + k]], a)
    out = []
    for lang in n:
        rank = []
        for (g, p), a in found.items():
            if g == lang and not (inside[g, p] and 100 * inside[g, p] >= cover * a):
                score, k = min((1000000 * a * a // (f[g, p[:k]] * f[g, p[k:]]), k) for k in range(1, len(p)))
                rank.append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
        out += [(lang, k + 1, p.decode(), -a, le, r, n[lang], -s) for k, (s, a, p, le, r) in enumerate(sorted(rank)[:top])]
    return sorted(out)


@pytest.mark.parametrize("longest,least,top,cover", [(3, 10, 2000, 50), (4, 6, 5, 80), (2, 3, 50, 50)])
def test_against_brute_force(spark, longest, least, top, cover, monkeypatch):
    monkeypatch.setattr(collocations, "WINDOW", 500)
    got = collocations.collocations(spark.createDataFrame(ROWS, SCHEMA).repartition(5), longest, least, top, cover)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == brute(ROWS, longest, least, top, cover)


def test_paths_are_whole_and_carry_their_edges(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    counts = collocations.grams(docs, 3, 10).checkpoint()
    ways = {(r["lang"], " ".join(r["words"])): r["n"] for r in collocations.paths(counts, 3).collect()}
    assert ways["und", "one two three four five six"] == 12
    edges = {(r["lang"], r["phrase"]): r["n"] for r in counts.where("length = 3").collect()}
    cut = {}
    for (lang, p), n in ways.items():
        w = p.split(" ")
        cut |= {(lang, " ".join(w[i:i + 3])): n for i in range(len(w) - 2)}
    assert cut == edges


def test_empty_table_and_words_only(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(1, None, None, None, None, None)], SCHEMA)).collect() == []


def test_decimal_scores_pass_64_bits(spark):
    counts = spark.createDataFrame([("x", 1, "a", 4 * 10**9), ("x", 1, "b", 5 * 10**9), ("x", 2, "a b", 3 * 10**9), ("x", 0, "", 10**10)], "lang string, length int, phrase string, n long")
    real = collocations.grams
    collocations.grams = lambda *a: counts
    try:
        assert tuple(collocations.collocations(counts, longest=2).first()) == ("x", 1, "a b", 3 * 10**9, 4 * 10**9, 5 * 10**9, 10**10, 450000)
    finally:
        collocations.grams = real


def test_distinct_wide_columns_and_blobs():
    big = np.array([1 << 40, 5, 1 << 40, 5], dtype=np.int64)
    d = grams.Distinct([big, big])
    assert d.columns[0].tolist() == [5, 1 << 40] and d.sums(np.array([1, 2, 3, 4])).tolist() == [6, 4] and d.inverse().tolist() == [1, 0, 1, 0]
    words, columns = grams.unpack(grams.pack([b"", "é".encode(), b"\0"], np.array([0, 255]), np.array([-1, 1 << 50]), np.zeros(0, dtype=np.int64)))
    assert words == [b"", "é".encode(), b"\0"] and [c.tolist() for c in columns] == [[0, 255], [-1, 1 << 50], []]
    dealt = grams.Dealt([np.array([2, 3, 4, 2])], grams.hashes([b"", b"", b"a", b"b", b"c"]), 3)
    assert sum(len(grams.unpack(b)[1][0]) for _, b in dealt.blobs([b"", b"", b"a", b"b", b"c"])) == 4


def test_query_reads_every_row(spark):
    from ..conftest import SF_SMALL

    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]
    assert sorted(map(tuple, QUERIES["op11_collocations"](spark, SF_SMALL).collect())) == brute(rows, 3, 10)
