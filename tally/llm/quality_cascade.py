"""Quality rules as a short-circuit cascade.

Each rule is a Column that is true when a document is rejected.  Before the
full pass every rule is run alone over a bounded sample: its wall time there
is its cost, the share it rejects its selectivity.  The full pass evaluates
the rules as one ``CASE`` in order of rejection per cost, so a document that
a cheap rule rejects never reaches the costly ones.  The order changes the
time and the recorded ``rejected_by``, never the verdict.

Defined results: a null text has no words and is rejected by ``few_words``;
an empty table gives an empty result; repeated rows are judged one by one;
extra columns pass through untouched.  A text of any length is judged whole;
repeats are found by sorting its windows, so the cost is n log n in its words.
"""

from __future__ import annotations

import string
import time
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
#: ASCII apart from letters; anything beyond ASCII counts as a letter.
_NOT_LETTERS = "".join(c for c in map(chr, range(128)) if not c.isalpha())
_BLANKS = "".join(map(chr, (0x20, 9, 10, 11, 12, 13)))

#: Rows the rule order is estimated on.
SAMPLE_ROWS = 512


def words(text: Column) -> Column:
    """Runs of anything but ASCII white space; null text: no words."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def chars_outside(text: Column, drop: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.length(F.translate(text, drop, "")).cast("long")


def word_chars(text: Column) -> Column:
    return chars_outside(text, _BLANKS)


def n_symbols(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long") - chars_outside(text, SYMBOLS)


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def n_dup_lines(lines: Column) -> Column:
    """Lines equal to an earlier line."""
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def with_repeat_words(df: DataFrame, word_col: str, out: str) -> DataFrame:
    """Add ``out``: the words in 3-word windows found twice or more.

    The windows are sorted with their positions, so equal ones are neighbours;
    the flagged positions, in order, cover ``min(3, gap to the next)`` words each.
    """
    w, hashes, ordered, same, marked = F.col(word_col), *(f"__{out}_{k}" for k in "hsem")
    n = F.size(w)
    tail = lambda c, k: F.slice(c, k, F.size(c))  # noqa: E731  the length may reach past the end
    pairs = F.zip_with(w, tail(w, 2), lambda a, b: F.concat(a, F.lit(" "), b))
    triples = F.zip_with(pairs, tail(w, 3), lambda a, b: F.xxhash64(F.concat(a, F.lit(" "), b)))
    # A window is known by the 64-bit hash of its words, space-joined.
    df = df.withColumn(hashes, F.when(n >= 3, F.slice(triples, 1, F.greatest(n - 2, F.lit(1)))))
    h = F.col(hashes)
    # Texts without a repeat skip the sort.
    df = df.withColumn(ordered, F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.arrays_zip(h.alias("g"), F.sequence(F.lit(1), F.size(h)).alias("p")))))
    g, p = F.col(ordered)["g"], F.col(ordered)["p"]
    as_next = F.zip_with(g, tail(g, 2), lambda a, b: F.coalesce(a == b, F.lit(False)))
    df = df.withColumn(same, as_next)
    flagged = F.zip_with(F.col(same), F.concat(F.array(F.lit(False)), F.slice(F.col(same), 1, F.size(F.col(same)) - 1)), lambda a, b: a | b)
    found = F.filter(F.zip_with(p, flagged, lambda a, f: F.when(f, a)), lambda a: a.isNotNull())
    df = df.withColumn(marked, F.when(F.size(g) > 0, F.sort_array(found)))
    m = F.col(marked)
    gaps = F.zip_with(m, tail(m, 2), lambda a, b: F.when(b.isNull() | (b - a > 3), F.lit(3)).otherwise(b - a))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)
    return df.withColumn(out, F.coalesce(F.when(F.size(m) > 0, total), F.lit(0).cast("long"))).drop(hashes, ordered, same, marked)


#: Per-document statistics every rule is written over; computed only where a rule needs them.
def with_stats(df: DataFrame, text_col: str, prefix: str = "__q_") -> DataFrame:
    """Add the statistics the rules read, under ``prefix``."""
    text = F.col(text_col)
    df = df.withColumn(prefix + "w", words(text)).withColumn(prefix + "l", lines_with_words(text))
    df = df.withColumn(prefix + "n_words", F.size(F.col(prefix + "w")).cast("long"))
    df = with_repeat_words(df, prefix + "w", prefix + "n_repeat_words")
    return (
        df.withColumn(prefix + "word_chars", word_chars(text))
        .withColumn(prefix + "n_symbols", n_symbols(text))
        .withColumn(prefix + "n_lines", F.size(F.col(prefix + "l")).cast("long"))
        .withColumn(prefix + "n_dup_lines", n_dup_lines(F.col(prefix + "l")))
        .drop(prefix + "w", prefix + "l")
    )


def rules(text: Column, stat=None) -> dict[str, Column]:
    """name -> rejected.  ``stat(name)`` gives a statistic that is already there."""
    t = F.coalesce(text, F.lit(""))
    n = stat("n_words") if stat else n_words(t)
    chars = stat("word_chars") if stat else word_chars(t)
    symbols = stat("n_symbols") if stat else n_symbols(t)
    lines = lines_with_words(t)
    n_lines = stat("n_lines") if stat else F.size(lines)
    dup = stat("n_dup_lines") if stat else n_dup_lines(lines)
    letters = chars_outside(t, _NOT_LETTERS)
    capitals = letters - chars_outside(t, _NOT_LETTERS + string.ascii_uppercase)
    return {
        "few_words": n < 50,
        "word_length": (chars < 2 * n) | (chars > 20 * n),
        "symbols": 10 * symbols > n,
        "dup_lines": 100 * dup > 50 * n_lines,
        "few_letters": 2 * letters < chars,
        "capitals": 10 * capitals > 7 * letters,
    }


def rank_rules(docs: DataFrame, checks: Mapping[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names by rejection per cost on a bounded sample, highest first."""
    sample = docs.limit(sample_rows).persist()
    try:
        n = sample.count()
        if not n:
            return list(checks)
        score = {}
        for name, rejected in checks.items():
            began = time.perf_counter()
            hit = sample.agg(F.sum(rejected.cast("int"))).first()[0] or 0
            score[name] = (hit + 0.5) / (n + 1) / max(time.perf_counter() - began, 1e-4)
    finally:
        sample.unpersist()
    return sorted(checks, key=lambda k: (-score[k], k))


def cascade(checks: Mapping[str, Column], order: list[str]) -> Column:
    """The first rule, in ``order``, that rejects; null: kept."""
    out = F.when(checks[order[0]], F.lit(order[0]))
    for name in order[1:]:
        out = out.when(checks[name], F.lit(name))
    return out


def judge(docs: DataFrame, text_col: str = "text", out: str = "rejected_by", sample_rows: int = SAMPLE_ROWS, stat_prefix: str = "__q_") -> DataFrame:
    """``docs`` with the statistics (under ``stat_prefix``) and ``out``.

    The window repeats need the document's words sorted, by far the costliest
    statistic; their rule stands last in the cascade whatever the sample says,
    because Spark computes an attribute of a lower projection for every row.
    """
    checks = rules(F.col(text_col))
    order = rank_rules(docs.select(text_col), checks, sample_rows)
    rows = with_stats(docs, text_col, stat_prefix)
    stat = lambda k: F.col(stat_prefix + k)
    ready = rules(F.col(text_col), stat) | {"repeated_words": 100 * stat("n_repeat_words") > 50 * stat("n_words")}
    return rows.withColumn(out, cascade(ready, order + ["repeated_words"]))


def quality_filter(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents no rule rejects, with their own columns."""
    judged = judge(docs, text_col, "__q_rejected_by", sample_rows)
    # A filter over the verdict alone would be pushed below the statistics, each copied into it
    # wherever it is used; one that also reads a row number stays above them.
    kept = judged.withColumn("__q_row", F.monotonically_increasing_id()).where(F.col("__q_rejected_by").isNull() & (F.col("__q_row") >= 0))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
