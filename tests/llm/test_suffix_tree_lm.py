"""Suffix-tree scores against a plain Python tree."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from tally.llm import grams, suffix_tree_lm
from tally.llm.checks import QUERIES

from ..conftest import SF_SMALL

SCHEMA = "doc_id long, text string, held_out string, window long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
RNG = np.random.default_rng(3)
#: Second-order text: "x a" is always followed by "p", "y a" by "q".
CHAIN = [" ".join(RNG.choice(["x A p", "y a q", "r s", "é\tß", "t"], size=int(RNG.integers(1, 80)))) for _ in range(80)]
ROWS = [(7 * k - 50, t, "own", 1) for k, t in enumerate(CHAIN)] + [
    (None, "x a p", None, None), (None, None, "own", 1), (1 << 60, "", "own", 1), ((1 << 60) + 1, " \n\t ", "own", 1),
    (900, "x a q never seen " + "w" * 200_000, "own", 1), (901, "x a p y a q " * 3000, "own", 1), (901, "x a p y a q " * 3000, "own", 1)]


def brute(rows, depth, least, weight, divergence):
    texts = [(d, zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0, [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if w] + [None]) for d, t, *_ in rows]
    n = Counter()
    for _, held, w in texts:
        if not held:
            for i in range(len(w)):
                for k in range(1, depth + 2):
                    if i - k + 1 >= 0:
                        n[tuple(w[i - k + 1:i + 1])] += 1
    words = [g for g in n if len(g) == 1]
    total, distinct = sum(n[g] for g in words), len(words)

    def p(context, y):
        if not context:
            return (n[y,] + 0.1) / (total + 0.1 * (distinct + 1))
        return (n[context + (y,)] + weight * p(context[1:], y)) / (n[context] + weight)

    gain = defaultdict(float)
    for g, c in n.items():
        s, y = g[:-1], g[-1]
        if s and n[s] >= least and c:
            q = p(s[1:], y)
            gain[s] += c * round((1 << 20) * math.log((c - 1 + weight * q) / (n[s] - 1 + weight) / q)) / (1 << 20)

    def is_state(s):
        return not s or (n[s] >= least and gain[s] >= divergence and is_state(s[1:]))

    out = []
    for d, held, w in texts:
        base = score = deep = 0
        for i, y in enumerate(w):
            s = max((tuple(w[i - k:i]) for k in range(min(depth, i) + 1) if is_state(tuple(w[i - k:i]))), key=len)
            base, score, deep = base + math.log10(p((), y)), score + math.log10(p(s, y)), deep + (len(s) > 0)
        out.append((d, held, len(w), sum(n[y,] > 0 for y in w), total, base, score, deep))
    return out


def same(got, expected):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    got, expected = sorted(map(tuple, got), key=key), sorted(expected, key=key)
    assert [r[:5] + r[7:] for r in got] == [r[:5] + r[7:] for r in expected]
    for g, e in zip(got, expected):
        assert g[5:7] == pytest.approx(e[5:7], rel=1e-9)


@pytest.mark.parametrize("depth,least,weight,divergence", [(2, 8, 4.0, 3.0), (1, 3, 1.0, 0.0), (3, 4, 2.0, 1.0)])
def test_against_a_plain_tree(spark, monkeypatch, depth, least, weight, divergence):
    monkeypatch.setattr(suffix_tree_lm, "WINDOW", 400)
    got = suffix_tree_lm.score(spark.createDataFrame(ROWS, SCHEMA).repartition(3), depth, least, weight, divergence)
    same(got.collect(), brute(ROWS, depth, least, weight, divergence))


def test_longer_contexts_are_learned():
    rows = brute(ROWS, 2, 8, 4.0, 3.0)
    held = [r for r in rows if r[1] and r[2] > 20]
    assert held and all(r[6] > r[5] for r in held)


def test_empty_and_untrained(spark):
    assert suffix_tree_lm.score(spark.createDataFrame([], SCHEMA)).collect() == []
    assert [tuple(r) for r in suffix_tree_lm.score(spark.createDataFrame([(None, "a b", None, None)], SCHEMA)).collect()] == [(None, True, 3, 0, 0, 0.0, 0.0, 0)]


def test_query_scores_every_document(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_suffix_tree_lm"](spark, SF_SMALL)
    assert got.columns[:7] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    got = got.collect()
    same(got, brute(rows, suffix_tree_lm.DEPTH, suffix_tree_lm.LEAST, suffix_tree_lm.WEIGHT, suffix_tree_lm.DIVERGENCE))
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def steps(model, texts, sorted_):
    """Runs the steps of ``score`` without Spark; the scores. What was sorted before the last step is forgotten."""
    shares = [(part, window, 1, blob) for window, words in zip(texts["window"], texts["words"]) for part, blob in enumerate(words) if blob is not None]
    met = pd.concat([suffix_tree_lm._words_met(model.parts)(g) for _, g in pd.DataFrame(shares, columns=["part", "window", "kind", "blob"]).groupby("part")])
    total, known = met[met["window"].isna()], met[met["window"].notna()]
    model.tokens, model.words = int(total["tokens"].sum()), int(total["words"].sum())
    each = lambda run: pd.concat([run((w,), texts[texts["window"] == w], known[known["window"] == w]) for w in texts["window"]])
    for step in range(1, model.depth + 2):
        asked = each(suffix_tree_lm._ask(step, model))
        known = pd.concat([known, *(suffix_tree_lm._met(g) for _, g in asked.groupby("part"))])
    sorted_.clear()
    return each(suffix_tree_lm._score(model))


def test_a_window_sorts_its_tokens_once_for_each_length_of_gram(monkeypatch):
    """op13's time: contexts were sorted like grams of their own, and every group looked for cycles."""
    sorted_, collected = [], []

    class Counted(grams.Distinct):
        def __init__(self, columns):
            sorted_.append(len(columns))
            super().__init__(columns)

    monkeypatch.setattr(suffix_tree_lm, "Distinct", Counted)
    monkeypatch.setattr(suffix_tree_lm.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})()))
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, *_ in ROWS]
    pdf = pd.DataFrame({"doc_id": [None if d is None else str(d) for d, *_ in ROWS], "held": held, "text": [t for _, t, *_ in ROWS]}, dtype=object)
    texts = pd.concat(list(suffix_tree_lm._windows(3)(iter([pdf]))))
    monkeypatch.setattr("gc.collect", lambda *a: collected.append(a))
    got = steps(suffix_tree_lm.Model(3, 2, 8, 4.0, 3.0), texts, sorted_)
    assert len(texts) == 1 and len(sorted_) == 2 and collected == []
    same([tuple(None if pd.isna(x) else x for x in r) for r in got.itertuples(index=False)], brute(ROWS, 2, 8, 4.0, 3.0))


@pytest.mark.parametrize("chunk", [1, 7, 64, 1 << 20])
def test_coded_texts_are_numbered_as_word_by_word(monkeypatch, chunk):
    texts = [suffix_tree_lm.tokens(t) for _, t, *_ in ROWS[-12:]] + [b"\n", b"   \n", " é  é ß\n".encode()]
    for some in (texts, texts[-3:-1], []):
        names = grams.Names()
        plain = [ids for t in some for ids in grams.number(t, names)]
        expected = [grams.spelled(names)[k] for k in np.concatenate(plain).tolist()] if plain else []
        monkeypatch.setattr(grams, "CHUNK", chunk)
        coded = grams.Coded()
        for t in some:
            coded.add(t)
        ids, words = coded.done()
        monkeypatch.undo()
        assert [words[k] for k in ids.tolist()] == expected and words[grams.END] == b"" and len(set(words)) == len(words)


def test_rows_in_order_fit_or_not():
    rng = np.random.default_rng(5)
    for tops in ((1, 1), (1 << 10, 9), (1 << 30, 1 << 30), (1 << 40, 1 << 40)):  # with their places, without, as rows
        columns = [rng.choice(rng.integers(0, top, 20), 500) for top in tops]
        found, order = grams.Distinct(columns), np.lexsort(columns[::-1])
        assert [tuple(r) for r in zip(*found.columns)] == sorted(set(zip(*(c.tolist() for c in columns))))
        assert (np.concatenate([c[found.order] for c in columns]) == np.concatenate([c[order] for c in columns])).all()
        assert found.sums(np.ones(500, dtype=np.int64))[found.inverse()].min() >= 1
