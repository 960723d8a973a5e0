"""Phrase collocations from a weighted de Bruijn graph of words.

Texts are cut into pieces and words.  An edge of the graph is a gram of
``longest`` words; it joins the nodes of its first and of its last ``longest -
1`` words.  Every word starts one edge, filled up with end marks behind the
piece's last word: those are the corrections at piece ends.  Edges are summed
over the corpus once.  A node's count is its flow, the sum over the edges that
leave it, corrections included, and the count of each shorter gram follows
from the flow of the grams one word longer in the same way; texts are read once.

Edges and nodes below the least count cannot take part in a candidate, so only
their flow lives on.  Of the edges left, unary paths are compacted: a node
whose whole count came in by one edge and leaves by one has no other
neighbours and joins both edges to one path, found by pointer doubling.  Such
a node is a phrase that stands inside longer candidates each time it stands
anywhere, so paths give the longest candidates and hide their inner nodes.
(A cycle of such nodes is impossible: some piece would have to start in it.)

Sums are taken by parts of a hash of the whole gram, partial sums first, so a
hot word or pair never meets in one task.

Defined results: null texts have no words, a null lang counts as ``und``;
ties are ordered as stated at ``collocations``; repeated rows count each time;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import ensure_checkpoint_dir, shuffle_partitions, ship_package
from .grams import END, Dealt, Distinct, Names, hashes, merge, number, spelled
from .memory import give_back, release_shuffles

#: Words of a task's text summed up before they are sent on.
WINDOW = 2_000_000
#: Bytes of text for one part of the sums.
PART_BYTES = 16 << 20

_ROWS = "part long, lang string, blob binary, phrase string, n long"
_SHAPE = bytes(ord("\n") if chr(c) in ".,;:!?\n\x0b\x0c\r" else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def pieces(text: str | None) -> bytes:
    """Lower-cased text whose words are parted by blanks and whose pieces end with line feeds."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_SHAPE) + b"\n"


def edges(ids: np.ndarray, longest: int) -> list[np.ndarray]:
    """For every word the gram that it starts, with end marks behind the end of its piece."""
    ids = np.append(ids, np.full(longest, END, dtype=ids.dtype))
    at = np.flatnonzero(ids != END)
    columns = [ids[at]]
    for k in range(1, longest):
        columns.append(np.where(columns[-1] == END, END, ids[at + k]))
    return columns


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["part", "lang", "blob", "phrase", "n"], dtype=object).astype({"part": "Int64", "n": "Int64"})


def _counted(longest: int, parts: int):
    """Texts to blobs of edges."""

    def flush(held):
        for lang, (names, arrays) in held.items():
            found = Distinct(edges(np.concatenate(arrays), longest))
            words = spelled(names)
            if len(found):
                dealt = Dealt(found.columns, hashes(words), parts)
                yield _frame([(p, lang, blob, None, None) for p, blob in dealt.blobs(words, found.sums(np.ones(len(found.order), dtype=np.int64)))])

    def run(batches):
        held, size = {}, 0
        for pdf in batches:
            for lang, text in zip(pdf["lang"].tolist(), pdf["text"].tolist()):
                names, arrays = held.setdefault(lang, (Names(), []))
                new = number(pieces(text), names)
                arrays += new
                size += sum(map(len, new))
                if size >= WINDOW:
                    yield from flush(held)
                    held, size = {}, 0
        yield from flush(held)
        give_back()

    return run


def _level(length: int, least: int, parts: int):
    """Sums of one part's grams: those of ``least`` or more as rows, the flow of all as blobs of one word less."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lang, of in pdf.groupby("lang", sort=True):
            names, columns, _ = merge(of["blob"].tolist(), length)
            found = Distinct(columns[:length])
            n = found.sums(columns[length])
            words = spelled(names)
            heavy = np.flatnonzero((n >= least) & (found.columns[-1] != END))
            for row in zip(n[heavy].tolist(), *[c[heavy].tolist() for c in found.columns]):
                out.append((None, lang, None, b" ".join(words[k] for k in row[1:]).decode("utf-8", "surrogatepass"), row[0]))
            if length == 1:
                out.append((None, lang, None, "", int(n.sum())))
            else:
                flow = Distinct(found.columns[:-1])
                dealt = Dealt(flow.columns, hashes(words), parts)
                out += [(p, lang, blob, None, None) for p, blob in dealt.blobs(words, flow.sums(n))]
        give_back()
        return _frame(out)

    return run


def grams(docs: DataFrame, longest: int, least: int) -> DataFrame:
    """lang, length, phrase and n of every gram of 1 to ``longest`` words that stands ``least`` times or more;
    length 0 has each lang's count of words."""
    spark = docs.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_partitions(spark), size // PART_BYTES)
    level, found = rows.mapInPandas(_counted(longest, parts), _ROWS), []
    for length in range(longest, 0, -1):
        level = level.where("part is not null").groupBy("part").applyInPandas(_level(length, least, parts), _ROWS).checkpoint()
        release_shuffles(spark)
        found.append(level.where("part is null").select("lang", F.when(F.col("phrase") == "", 0).otherwise(length).alias("length"), "phrase", "n"))
    heavy = found[0]
    for more in found[1:]:
        heavy = heavy.unionByName(more)
    return heavy.groupBy("lang", "length", "phrase").agg(F.sum("n").alias("n"))


def _words(phrase):
    return F.split(phrase, " ", -1)


def _part(words, at, length):
    """``length`` words from place ``at`` (from 1), space-joined."""
    return F.array_join(F.slice(words, at, length), " ")


def paths(counts: DataFrame, longest: int) -> DataFrame:
    """lang, words and n of the compacted unary paths of the edges in ``counts`` (from ``grams``)."""
    w = _words(F.col("phrase"))
    edge = counts.where(F.col("length") == longest).select(
        "lang", "phrase", "n", _part(w, 1, longest - 1).alias("tail"), _part(w, 2, longest - 1).alias("head"))
    node = counts.where(F.col("length") == longest - 1).select("lang", F.col("phrase").alias("node"), F.col("n").alias("whole"))
    into = edge.select("lang", F.col("head").alias("node"), F.col("n").alias("whole"), F.col("phrase").alias("before"))
    out = edge.select("lang", F.col("tail").alias("node"), F.col("n").alias("whole"), F.col("phrase").alias("after"))
    # An edge that carries all of a node's count leaves nothing for another one.
    links = node.join(into, ["lang", "node", "whole"]).join(out, ["lang", "node", "whole"]).select("lang", F.col("after").alias("phrase"), F.col("before").alias("to"))
    at = edge.select("lang", "phrase", "n").join(links, ["lang", "phrase"], "left").select(
        "lang", "phrase", "n", F.coalesce("to", "phrase").alias("to"), F.col("to").isNotNull().cast("long").alias("steps")).checkpoint()
    while True:
        far = at.select("lang", F.col("phrase").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"))
        at = at.join(far, ["lang", "to"]).select("lang", "phrase", "n", F.col("far").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("more") > 0).alias("moved")).checkpoint()
        if at.where("moved").isEmpty():
            break
    joined = at.groupBy("lang", F.col("to").alias("first")).agg(
        F.sort_array(F.collect_list(F.struct("steps", F.element_at(_words(F.col("phrase")), -1).alias("word")))).alias("ends"), F.first("n").alias("n"))
    rest = F.transform(F.slice(F.col("ends"), 2, F.greatest(F.size("ends") - 1, F.lit(0))), lambda e: e["word"])
    return joined.select("lang", F.concat(_words(F.col("first")), rest).alias("words"), "n")


def candidates(counts: DataFrame, longest: int) -> DataFrame:
    """lang, phrase, length and a of every phrase of 2 words or more, but those inside a path, where a longer one stands each time."""
    ways = paths(counts, longest).checkpoint()
    # An inner node is a window of ``longest - 1`` words that is neither the path's first nor its last.
    windows = lambda length, skip: F.expr(
        f"transform(filter(sequence(1, size(words)), p -> p > {skip} and p + {length} - 1 + {skip} <= size(words)), p -> array_join(slice(words, p, {length}), ' '))")
    top = ways.select("lang", F.explode(windows(longest, 0)).alias("phrase"), F.lit(longest).alias("length"), F.col("n").alias("a"))
    inner = ways.where(F.size("words") > longest).select("lang", F.explode(windows(longest - 1, 1)).alias("phrase"))
    rest = counts.where((F.col("length") > 1) & (F.col("length") < longest)).join(inner, ["lang", "phrase"], "left_anti")
    return top.unionByName(rest.select("lang", "phrase", "length", F.col("n").alias("a")))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, top: int = 2000, cover: int = 50) -> DataFrame:
    """The ``top`` phrases of each lang by score, then by ``a`` (both descending), then by phrase in byte order.

    Score: floor(1000000 * a * a / (l * r)) of the cut with the least (ties: the first cut).  A phrase that stands
    inside a longer candidate with ``cover`` per cent of its count or more gives way to it.
    """
    counts = grams(docs, longest, least).checkpoint()
    found = candidates(counts, longest).checkpoint()
    w = _words(F.col("phrase"))
    inside = found.where("length > 2").select("lang", F.col("a").alias("outer"), w.alias("w"), "length").select(
        "lang", "outer", F.explode(F.expr("flatten(transform(sequence(2, length - 1), k -> transform(sequence(1, length - k + 1), p -> array_join(slice(w, p, k), ' '))))")).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    left = found.join(inside, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (100 * F.col("outer") < cover * F.col("a"))).drop("outer")
    cuts = left.select("*", w.alias("w")).select("lang", "phrase", "length", "a", "w", F.explode(F.expr("sequence(1, length - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("w"), F.lit(1), F.col("k")).alias("__l"), _part(F.col("w"), F.col("k") + 1, F.col("length")).alias("__r"))
    known = counts.where("length > 0").select("lang", "phrase", "n")
    for side in ("l", "r"):
        cuts = cuts.join(known.select("lang", F.col("phrase").alias(f"__{side}"), F.col("n").alias(side)), ["lang", f"__{side}"])
    exact = lambda c: f"cast({c} as decimal(15,0))"
    scored = cuts.withColumn("score", F.expr(f"({exact('a')} * {exact('a')} * cast(1000000 as decimal(7,0))) div ({exact('l')} * {exact('r')})"))
    least_cut = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    totals = counts.where("length = 0").select("lang", F.col("n").alias("total"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase")))
    return least_cut.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
