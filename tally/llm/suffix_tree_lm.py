"""Language-model scores from a probabilistic suffix tree of words.

A state of the tree is a context of up to ``depth`` words.  A context is a
state if it stands ``least`` times or more in training texts, its own suffix
is a state, and its next-word distribution diverges from that of its suffix:
over the context's training tokens, each left out in turn, the sum of
ln(p(word | context) / p(word | suffix)) must reach ``divergence`` nats.

Distributions are smoothed towards the suffix, root last:
p(w | s) = (n(s w) + weight * p(w | suffix of s)) / (n(s) + weight), and at the
root p(w) = (c + 0.1) / (N + 0.1 (V + 1)), so that each state's probabilities
add up to 1 with one place for words never seen.  A token is scored in the
state of the longest suffix of the words before it in its text.

How it runs: texts are numbered once in windows of some million tokens (a
checkpoint), each with a numbering of its own, by Arrow.  A gram is the gram
before it and a word more, and a context is a gram of the token before, so that
a window sorts its tokens once for each length of gram.  What a window needs from the
corpus are sums by word or gram: training counts, and the divergence of
contexts, whose terms each window adds up over its own tokens.  A window sends
its distinct words or grams with its share of each sum to the parts of a hash
of the gram, where shares meet, and gets the sums of its own back; with the
words' counts come corpus-wide numbers, small ones for frequent words, so that
grams travel as numbers.  Grams of k + 1 words are asked for only behind
contexts that stand often enough.  No table is broadcast; divergence terms are
whole numbers of 2**-20 nats, so sums do not depend on the windows.

Defined results: null texts are empty; an empty text is its end token alone; a
null doc_id counts as the empty text and so is held out; repeated rows are
scored, and learned from, each time; without training texts every score is
that of the empty model (0); other columns are not read; no rows, no rows.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffle_partitions, ship_package
from .grams import END, Coded, Dealt, Distinct, hashes, pack, unpack
from .memory import give_back, release_shuffles

#: Tokens of a window, and bytes of text for each.
WINDOW, WINDOW_BYTES = 2_200_000, 16
PART_BYTES = 16 << 20
#: Words of the longest context, and the least training tokens behind a state.
DEPTH, LEAST = 2, 8
#: Tokens that the suffix's distribution weighs, and nats a context must gain.
WEIGHT, DIVERGENCE = 4.0, 3.0
#: Steps of a divergence term in a nat.
_STEPS = 1 << 20
#: Kinds of sums: words 1, grams of k words k, divergences of contexts of d words this and d.
_GAIN = 100

_WINDOWS = "window long, words array<binary>, tokens binary"
_SHARES = "part long, window long, kind int, blob binary"
_SUMS = "window long, kind int, part long, blob binary, tokens long, words long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_in_context long"
_SHAPE = bytes(0x20 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0


def tokens(text: str | None) -> bytes:
    """Lower-cased text with blanks between words and one end mark."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SHAPE) + b"\n"


def _windows(parts: int):
    """Texts to windows: their words with training counts by the part that counts them, and their tokens with the part of each word."""

    def flush(window, docs, texts):
        doc_ids, null, held = (np.array(c, dtype=np.int64) for c in zip(*docs))
        ids, words = texts.done()
        lengths = np.diff(np.flatnonzero(ids == END), prepend=-1)
        part = (hashes(words) % np.uint64(parts)).astype(np.int64)
        counts = np.bincount(ids[np.repeat(held == 0, lengths)], minlength=len(words))
        sent = _sent(part)
        bounds = np.searchsorted(part[sent], np.arange(parts + 1))
        of = [sent[i:j] for i, j in zip(bounds, bounds[1:])]
        asked = [pack([words[k] for k in some.tolist()], counts[some]) if len(some) else None for some in of]
        return pd.DataFrame({"window": [window], "words": [asked], "tokens": [pack([], ids, lengths, doc_ids, null, held, part)]})

    def run(batches):
        first = TaskContext.get().partitionId() << 32
        made, docs, texts, size = 0, [], Coded(), 0
        for pdf in batches:
            for doc_id, held, text in zip(pdf["doc_id"].tolist(), pdf["held"].tolist(), pdf["text"].tolist()):
                text = tokens(text)
                texts.add(text)
                docs.append((0 if doc_id is None else int(doc_id), doc_id is None, bool(held)))
                # Tokens at most; long words take memory as well.
                size += max(text.count(b" ") + 2, len(text) // WINDOW_BYTES)
                if size >= WINDOW:
                    yield flush(first + made, docs, texts)
                    made, docs, texts, size = made + 1, [], Coded(), 0
        if docs:
            yield flush(first + made, docs, texts)
        give_back()

    return run


def _sent(part: np.ndarray) -> np.ndarray:
    """A window's words by the part that counts them."""
    return np.argsort(part, kind="stable")


class Model:
    """The settings, and what the whole corpus gives: training tokens and distinct training words."""

    def __init__(self, parts: int, depth: int, least: int, weight: float, divergence: float, tokens: int = 0, words: int = 0):
        self.parts, self.depth, self.least, self.weight, self.divergence = parts, depth, least, weight, divergence
        self.tokens, self.words = tokens, words


class Window:
    """The tokens of one window, with the sums known so far."""

    def __init__(self, blob: bytes, model: Model, sums: dict[int, list[list[np.ndarray]]]):
        self.model, self.sums = model, sums
        _, (ids, self.lengths, self.docs, self.null, self.held, part) = unpack(blob)
        self.ids = ids.astype(np.int32)
        self.train = np.repeat(self.held == 0, self.lengths)
        self.named, self.count = np.zeros(len(part), dtype=np.int64), np.zeros(len(part), dtype=np.int64)
        sent = _sent(part)
        #: The corpus-wide number and count of each of the window's words.
        for k, column in enumerate((self.named, self.count)):
            column[sent] = np.concatenate([x[k] for x in sums[1]])
        #: At k, the distinct grams of k words as columns of corpus-wide numbers, and for every token the row of the gram that ends there (-1: not asked for).
        self.columns, self.row = {1: [self.named]}, {1: self.ids}

    def _answers(self, kind: int) -> list[np.ndarray]:
        return [x[0] for x in self.sums[kind]]

    def grams(self, k: int, at: np.ndarray) -> tuple[Distinct, Dealt]:
        """Distinct grams of ``k`` > 1 words that end at some tokens, the words before them a gram asked for."""
        found = Distinct([self.row[k - 1][at - 1], self.ids[at]])
        context, last = found.columns
        self.columns[k] = [c[context] for c in self.columns[k - 1]] + [self.named[last]]
        return found, Dealt(self.columns[k], None, self.model.parts)

    def contexts(self, d: int, at: np.ndarray) -> tuple[np.ndarray, Dealt]:
        """The distinct contexts of ``d`` words before some tokens, which are grams asked for, and for each token the place of its own."""
        row = self.row[d][at - 1]
        used = np.zeros(len(self.columns[d][0]), dtype=bool)
        used[row] = True
        return (np.cumsum(used) - 1)[row], Dealt([c[used] for c in self.columns[d]], None, self.model.parts)

    def counts(self, k: int, at: np.ndarray) -> np.ndarray:
        """For every token the training count of the ``k`` words that end there (0 where not asked for)."""
        found, dealt = self.grams(k, at)
        inverse = found.inverse()
        self.row[k] = np.full(len(self.ids), -1, dtype=np.int32)
        self.row[k][at] = inverse
        out = np.zeros(len(self.ids), dtype=np.int64)
        out[at] = dealt.placed(self._answers(k))[inverse]
        return out

    def levels(self):
        """For each depth whose counts are known: tokens with a context that stands often, its count there, every token's gram count, its probability."""
        m = self.model
        count = self.count[self.ids]
        p = ((self.count + 0.1) / (m.tokens + 0.1 * (m.words + 1)))[self.ids]
        yield None, None, count, p
        # Tokens with d words before them in their text.
        there = first = np.concatenate([np.zeros(1, dtype=bool), self.ids[:-1] != END])
        for d in range(1, m.depth + 1):
            if d > 1:
                there = first & np.concatenate([np.zeros(1, dtype=bool), there[:-1]])
            often = np.flatnonzero(there)
            context = count[often - 1]
            often, context = often[context >= m.least], context[context >= m.least]
            if d + 1 not in self.sums:
                yield often, context, None, None
                return
            count = self.counts(d + 1, often)
            longer = p.copy()
            longer[often] = (count[often] + m.weight * p[often]) / (context + m.weight)
            p = longer
            yield often, context, count, p

    def gains(self, d: int, levels: list) -> tuple[Dealt, np.ndarray]:
        """This window's share of the divergence of each context of ``d`` words."""
        often, context, count, _ = levels[d]
        place, dealt = self.contexts(d, often)
        use = self.train[often]
        at, context = often[use], context[use]
        shorter, w = levels[d - 1][3][at], self.model.weight
        left_out = (count[at] - 1 + w * shorter) / (context - 1 + w)
        sums = np.zeros(len(dealt.order), dtype=np.int64)
        np.add.at(sums, place[use], np.rint(_STEPS * np.log(left_out / shorter)).astype(np.int64))
        return dealt, sums

    def shares(self, step: int):
        """(kind, part, blob) of what this window asks for in a step."""
        levels = list(self.levels())
        if step <= self.model.depth:
            often = levels[step][0]
            found, dealt = self.grams(step + 1, often)
            for p, blob in dealt.blobs(None, found.sums(self.train[often].astype(np.int64))):
                yield step + 1, p, blob
        if step > 1:
            dealt, gains = self.gains(step - 1, levels)
            for p, blob in dealt.blobs(None, gains):
                yield _GAIN + step - 1, p, blob

    def scores(self) -> pd.DataFrame:
        levels = list(self.levels())
        base, count = levels[0][3], levels[0][2]
        p, state = base.copy(), np.ones(len(self.ids), dtype=bool)
        for d in range(1, self.model.depth + 1):
            often = levels[d][0]
            place, dealt = self.contexts(d, often)
            kept = (dealt.placed(self._answers(_GAIN + d)) >= self.model.divergence * _STEPS)[place]
            at = often[kept & state[often]]
            state = np.zeros(len(self.ids), dtype=bool)
            state[at] = True
            p[at] = levels[d][3][at]
            deep = state if d == 1 else deep
        starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        per = lambda x: np.add.reduceat(x, starts)
        return pd.DataFrame({
            "doc_id": pd.array(np.where(self.null, 0, self.docs), dtype="Int64"), "held_out": self.held != 0, "n_tokens": self.lengths,
            "n_known": per((count > 0).astype(np.int64)), "train_tokens": self.model.tokens, "base_score": per(np.log10(base)),
            "score": per(np.log10(p)), "n_in_context": per(deep.astype(np.int64))}).assign(doc_id=lambda f: f["doc_id"].mask(self.null != 0))


def _back(rows: list[tuple]) -> pd.DataFrame:
    give_back(cycles=False)
    return pd.DataFrame(rows, columns=["window", "kind", "part", "blob", "tokens", "words"], dtype=object).astype(
        {"window": "Int64", "kind": "int32", "part": "int64", "tokens": "Int64", "words": "Int64"})


def _words_met(parts: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """One part's words: counts, and numbers by falling count, sent back to the windows that asked."""
        pdf = pdf.sort_values("window")
        part, names, asked, counts = int(pdf["part"].iloc[0]), defaultdict(), [], []
        names.default_factory = names.__len__
        for blob in pdf["blob"]:
            words, (n,) = unpack(blob)
            asked.append(np.fromiter(map(names.__getitem__, words), dtype=np.int64, count=len(words)))
            counts.append(n)
        total = np.zeros(len(names), dtype=np.int64)
        for ids, n in zip(asked, counts):
            total[ids] += n
        number = np.empty(len(names), dtype=np.int64)
        number[np.argsort(-total, kind="stable")] = np.arange(len(names)) * parts + part
        rows = [(window, 1, part, pack([], number[ids], total[ids]), None, None) for window, ids in zip(pdf["window"].tolist(), asked)]
        return _back([*rows, (None, 1, part, None, int(total.sum()), int((total > 0).sum()))])

    return run


def _met(pdf: pd.DataFrame) -> pd.DataFrame:
    """One part's sums by gram, sent back to the windows that asked."""
    out = []
    for kind, of in pdf.groupby("kind", sort=True):
        found = [unpack(b)[1] for b in of["blob"]]
        *columns, shares = (np.concatenate(c) for c in zip(*found))
        met = Distinct(columns)
        sums = np.split(met.sums(shares)[met.inverse()], np.cumsum([len(f[0]) for f in found])[:-1])
        out += [(window, int(kind), int(part), pack([], x), None, None) for window, part, x in zip(of["window"].tolist(), of["part"].tolist(), sums)]
    return _back(out)


def _sums(rows: pd.DataFrame, kinds: list[int]) -> dict[int, list[list[np.ndarray]]]:
    """The columns of each kind of sum by part; what no token asked for has none."""
    rows = rows.sort_values(["kind", "part"])
    return {k: [] for k in kinds} | {int(kind): [unpack(b)[1] for b in of["blob"]] for kind, of in rows.groupby("kind")}


def _kinds(step: int, depth: int) -> list[int]:
    """Kinds whose sums are known when a step begins."""
    return [1] + [k for s in range(1, step) for k in ([s + 1] if s <= depth else []) + ([_GAIN + s - 1] if s > 1 else [])]


def _ask(step: int, model: Model):
    def run(key, texts: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        out = []
        for blob in texts["tokens"].tolist():
            window = Window(blob, model, _sums(sums, _kinds(step, model.depth)))
            out += [(p, int(key[0]), kind, b) for kind, p, b in window.shares(step)]
        give_back(cycles=False)
        return pd.DataFrame(out, columns=["part", "window", "kind", "blob"])

    return run


def _score(model: Model):
    def run(key, texts: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        known = _sums(sums, _kinds(model.depth + 2, model.depth))
        out = [Window(blob, model, known).scores() for blob in texts["tokens"].tolist()]
        give_back(cycles=False)
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in SCORES.split(", ")})

    return run


def score(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, weight: float = WEIGHT, divergence: float = DIVERGENCE) -> DataFrame:
    """One row for each document: its tokens, those known, the base score and the tree's log10 probability of the text."""
    spark = docs.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), held_out(F.col("doc_id")).alias("held"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), size // PART_BYTES)
    texts = rows.mapInPandas(_windows(parts), _WINDOWS).checkpoint()
    asked = texts.select("window", F.posexplode("words").alias("part", "blob")).where("blob is not null")
    asked = asked.select(F.col("part").cast("long").alias("part"), "window", F.lit(1).alias("kind"), "blob")
    met = asked.groupBy("part").applyInPandas(_words_met(parts), _SUMS).checkpoint()
    release_shuffles(spark)
    # One row for each part.
    total = met.where("window is null").agg(F.sum("tokens"), F.sum("words")).first()
    model = Model(parts, depth, least, weight, divergence, int(total[0] or 0), int(total[1] or 0))
    tokens_of = texts.select("window", "tokens").groupBy("window")
    known = met.where("window is not null")
    for step in range(1, depth + 2):
        shares = tokens_of.cogroup(known.groupBy("window")).applyInPandas(_ask(step, model), _SHARES)
        met = shares.groupBy("part").applyInPandas(_met, _SUMS).checkpoint()
        del shares
        release_shuffles(spark)
        known = known.unionByName(met)
    return tokens_of.cogroup(known.groupBy("window")).applyInPandas(_score(model), SCORES)
