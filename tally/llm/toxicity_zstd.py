"""Toxicity by compression distance: a window's length under two zstandard dictionaries.

One dictionary is trained on windows of toxic text, one on windows of ordinary
text.  A window is a word between spaces; each of its bytes is written as three
so that a word the dictionary knows saves more than zstandard's own overhead.
The distance is the window's compressed length under the ordinary dictionary
less that under the toxic one.

The toxic samples are the words whose share of toxic training documents is
``LIFT`` times their share of ordinary ones or more, on ``EVIDENCE`` nats of
proof, each as often as documents hold it, the best proven first until the
dictionary is full; toxic prose is mostly ordinary, and its common words would
fill the dictionary.  The bars are counts of documents, not shares, so that the
words of a small language come in with more labels.

A document's surprise is that of as many windows above the threshold or more,
if its windows were those of ordinary text, so that length alone makes nothing
toxic.  On training documents kept out of the dictionaries the threshold on the
distance and the cut on the surprise are those that part the labels best, and
the score is the smoothed share of toxic documents among those as surprising.

Training sees at most ``PER_CLASS`` labelled documents of each class and stops
taking more once ``TRAIN_CHARS`` characters of a class are reached, the
documented bounds of the fit; each text is whole, as in scoring.  Labels are
read for training rows alone.

Defined results: null or wordless text has no window and the score of a
document without any above the threshold; if a class has no training row, every
score is that class mix's prior; repeated rows score alike; an empty table
gives no rows; extra columns pass through and one named like the result gives way.
"""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

PER_CLASS = 2000
#: Characters of the training texts of a class after which no further text is taken.
TRAIN_CHARS = 32_000_000
LIFT = 20.0
#: Training documents a word of the toxic dictionary is in, at least, and the log likelihood ratio of its share in them.
MIN_DOCS = 3
EVIDENCE = 7.0
TOXIC_BYTES, ORDINARY_BYTES = 16_384, 112_640
#: Nats above the cut at which scores change.
STEPS = (0.0, 2.0, 5.0)
#: Distinct words a worker remembers the distance of.
CACHE_WORDS = 500_000

_STRETCH = [bytes((c, c ^ 0x80, (c * 7 + 3) & 255)) for c in range(256)]


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def window(word: str) -> bytes:
    return b"".join(_STRETCH[c] for c in b" %s " % word.encode("utf-8", "surrogatepass"))


def surprise(k: int, expected: float) -> float:
    """Nats of ``k`` or more hits where so many are expected (Poisson); 0 if no more than that."""
    if k <= expected:
        return 0.0
    term = total = 1.0
    at = k
    while term > 1e-9 * total:
        at += 1
        term *= expected / at
        total += term
    return max(0.0, expected + math.lgamma(k + 1) - k * math.log(expected) - math.log(total))


class Model:
    """Both dictionaries, the threshold, the share of ordinary windows above it, the cuts on the surprise and the scores between them."""

    def __init__(self, toxic: bytes, ordinary: bytes, threshold: int, scores: list[float], rate: float = 1.0, cuts: tuple[float, ...] = ()):
        self.toxic, self.ordinary, self.threshold, self.scores, self.rate, self.cuts = toxic, ordinary, threshold, scores, rate, cuts
        self._ready()

    def _ready(self):
        import zstandard as z

        params = z.ZstdCompressionParameters.from_level(3, format=z.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_dict_id=0, write_checksum=0)
        self.press = []
        for raw in (self.ordinary, self.toxic):
            d = z.ZstdCompressionDict(raw)
            if raw:
                d.precompute_compress(compression_params=params)
            self.press.append(z.ZstdCompressor(dict_data=d, compression_params=params).compress if raw else None)
        self.known: dict[str, int] = {}

    def __getstate__(self):
        return self.toxic, self.ordinary, self.threshold, self.scores, self.rate, self.cuts

    def __setstate__(self, state):
        self.__init__(*state)

    def distance(self, word: str) -> int:
        w = window(word)
        return len(self.press[0](w)) - len(self.press[1](w))

    def distances(self, text: str | None) -> list[int]:
        if not self.toxic:
            return []
        ws, known = words(text), self.known
        out = list(map(known.get, ws))
        if None in out:
            if len(known) > CACHE_WORDS:
                known.clear()
            for w in ws:
                if w not in known:
                    known[w] = self.distance(w)
            out = list(map(known.__getitem__, ws))
        return out

    def score(self, text: str | None) -> float:
        far = self.distances(text)
        found = surprise(sum(d >= self.threshold for d in far), self.rate * len(far))
        return self.scores[sum(found >= c for c in self.cuts)]


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees."""
    return _fold(doc_id) == 0


def _samples(counts: Counter, limit: int, rng: random.Random) -> list[bytes]:
    out = [w for k, c in sorted(counts.items()) for w in [window(k)] * min(c, limit)]
    rng.shuffle(out)
    return out


def train(rows: list[tuple[int, str]]) -> Model:
    """Fit on (toxic, text) of the bounded training sample."""
    import zstandard as z

    rng = random.Random(0)
    texts = {y: list(dict.fromkeys(t for x, t in rows if x == y)) for y in (0, 1)}
    if not texts[0] or not texts[1]:
        return Model(b"", b"", 1, [1.0 if texts[1] else 0.0 if texts[0] else 0.5])
    # Every fourth document calibrates, the others train.
    fit = {y: [t for k, t in enumerate(v) if k % 4] or v for y, v in texts.items()}
    check = {y: v[::4] for y, v in texts.items()}
    n = {y: len(v) for y, v in fit.items()}
    seen = {y: Counter(w for t in v for w in set(words(t))) for y, v in fit.items()}
    marked = _marked(seen, n)
    if not marked:
        return Model(b"", b"", 1, [n[1] / (n[0] + n[1])])
    dicts = []
    for samples, size in ((_samples(marked, 10_000, rng), TOXIC_BYTES), (_samples(Counter({w: c for w, c in seen[0].items() if c > 1}), 20, rng), ORDINARY_BYTES)):
        try:
            dicts.append(z.train_dictionary(size, samples).as_bytes())
        except z.ZstdError:  # too few samples to train on: their own bytes are the dictionary
            dicts.append(b"".join(dict.fromkeys(samples))[:size] or b" " * 8)
    model = Model(*dicts, 1, [0.5])
    far = {y: [model.distances(t) for t in v] for y, v in check.items()}

    # Sorted distances, so that the hits above a threshold are one search.
    far = {y: [np.sort(v) for v in vs] for y, vs in far.items()}
    windows = {y: np.array([len(v) for v in vs]) for y, vs in far.items()}
    best = (-2.0, 0.0, 1, 1.0, 1.0, far)
    for t in range(1, 64):
        hits = {y: np.array([len(v) - np.searchsorted(v, t) for v in vs], dtype=int) for y, vs in far.items()}
        rate = (hits[0].sum() + 0.5) / (windows[0].sum() + 1)
        found = {y: np.array([surprise(int(k), rate * int(m)) for k, m in zip(hits[y], windows[y])]) for y in hits}
        levels = np.unique(np.concatenate([[0.0], *found.values()]))
        for below, level in zip(levels, levels[1:]):
            gain = float(np.mean(found[1] >= level) - np.mean(found[0] >= level))
            # Of equal ones the widest gap.
            if (gain, level - below, t) > best[:3]:
                best = (gain, float(level - below), t, rate, float(below + level) / 2, found)
    if best[0] <= -2.0:  # no document has a window above any threshold
        model.scores = [n[1] / (n[0] + n[1])]
        return model
    _, _, model.threshold, model.rate, cut, found = best
    model.cuts = tuple(cut + x for x in STEPS)
    scores = []
    for level in range(len(model.cuts) + 1):
        at = {y: sum(sum(x >= c for c in model.cuts) == level for x in v) for y, v in found.items()}
        # Shares of each class, so that the classes' sizes in the sample don't matter.
        share = {y: (at[y] + 0.5) / (len(found[y]) + 1) for y in found}
        scores.append(share[1] / (share[0] + share[1]))
    model.scores = np.maximum.accumulate(scores).tolist()
    return model


def _marked(seen: dict[int, Counter], n: dict[int, int]) -> Counter:
    """Documents of each word of the toxic dictionary; where none is proven, the best words there are."""
    p = n[1] / (n[0] + n[1])

    def evidence(w: str, c: int) -> float:
        c0 = seen[0][w]
        return c * math.log(c / (c + c0) / p) + (c0 * math.log(c0 / (c + c0) / (1 - p)) if c0 else 0.0)

    more = [(evidence(w, c), w, c) for w, c in seen[1].items() if c * n[0] > seen[0][w] * n[1]]
    proven = [x for x in more if x[0] >= EVIDENCE and x[2] >= MIN_DOCS and x[2] * n[0] >= LIFT * seen[0][x[1]] * n[1]]
    out, size = Counter(), 0
    for _, w, c in sorted(proven or more, key=lambda x: (-x[0], x[1])):
        size += len(window(w))
        if out and size > TOXIC_BYTES:
            break
        out[w] = c
    return out


def sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[tuple[int, str]]:
    """At most ``per_class`` training rows of each label, chosen by a hash of doc_id."""
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).dropDuplicates(["doc_id"])
    parts = [rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    picked = parts[0].unionByName(parts[1])
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    # At most 2 * per_class ids: a bounded side.
    got = texts.join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").select("toxic", "text").limit(2 * per_class)
    taken, out = [0, 0], []
    for y, text in got.toLocalIterator():
        if taken[y] < TRAIN_CHARS:
            taken[y] += len(text)
            out.append((y, text))
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``score``."""
    spark = docs.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def toxic(texts: pd.Series) -> pd.Series:
        model = shared.value
        return pd.Series([model.score(t) for t in texts.tolist()], dtype="float64")

    return docs.withColumn("score", toxic(F.col("text").cast("string")))
