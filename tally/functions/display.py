"""Presentation-side data functions kept as column functions (H1, H6, H7).

All are JVM regular-expression expressions over whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import col
from .numbers import format_metric

# Date forms accepted by the typed value (the browser's
# Date.parse is implementation-defined; this list is ours).
DATE_FORMATS = ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy"]
KIND_RANK = {"number": 0, "date": 1, "text": 2, "empty": 3}


def typed_value(c, dtype: T.DataType | None = None) -> Column:
    """H1: ``struct(kind, num, ts, txt)`` for sorting a displayed value.

    empty (null or ''), number (numeric type, or text that is a plain
    decimal once commas and spaces are removed), date (one of
    ``DATE_FORMATS``), else text lower-cased.
    """
    x = col(c)
    if dtype is not None and isinstance(dtype, (T.NumericType,)):
        num = x.cast("double")
        return F.struct(
            F.when(x.isNull(), F.lit("empty")).otherwise(F.lit("number")).alias("kind"),
            num.alias("num"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(None).cast("string").alias("txt"),
        )
    s = x.cast("string")
    t = F.trim(s)
    cand = F.regexp_replace(t, "[, ]", "")
    is_num = cand.rlike(r"^-?\d+(\.\d+)?$")
    ts = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("timestamp_ntz") for f in DATE_FORMATS])
    kind = (
        F.when(s.isNull() | (s == ""), F.lit("empty"))
        .when(is_num, F.lit("number"))
        .when(ts.isNotNull(), F.lit("date"))
        .otherwise(F.lit("text"))
    )
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "number", cand.try_cast("double")).alias("num"),
        F.when(kind == "date", ts).alias("ts"),
        F.when(kind == "text", F.lower(t)).alias("txt"),
    )


def kind_rank(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    expr = None
    for k, r in KIND_RANK.items():
        expr = (F.when(kind == k, F.lit(r)) if expr is None else expr.when(kind == k, F.lit(r)))
    return expr.otherwise(out)


# Fixed value: the stand-alone number pattern of the rich-text cleanup.
NUMBER_PATTERN = r"(?<![A-Za-z0-9])(-?\d{1,3}(?:,\d{3})*(?:\.\d+)?|-?\d{4,}(?:\.\d+)?)(?![A-Za-z0-9])"


def rich_text(c) -> Column:
    """H6: drop ``**``, ``__`` and back-quote marks; rewrite stand-alone numbers by H4
    unless they are below 1000 and have no decimal point.

    The text is split on the number pattern and the pieces are re-joined with
    each match rewritten (``split`` + ``regexp_extract_all`` + ``zip_with``).
    """
    s = F.coalesce(col(c).cast("string"), F.lit(""))
    s = F.regexp_replace(s, r"\*\*(.*?)\*\*", "$1")
    s = F.regexp_replace(s, r"__(.*?)__", "$1")
    s = F.regexp_replace(s, r"`([^`]+)`", "$1")
    pieces = F.split(s, NUMBER_PATTERN, -1)
    matches = F.concat(F.regexp_extract_all(s, F.lit(NUMBER_PATTERN), 0), F.array(F.lit("")))

    def rewrite(m: Column) -> Column:
        num = F.regexp_replace(m, ",", "").try_cast("double")
        keep = (m == "") | num.isNull() | ((F.abs(num) < 1000) & ~m.contains("."))
        return F.when(keep, m).otherwise(format_metric(num))

    return F.array_join(F.zip_with(pieces, matches, lambda p, m: F.concat(F.coalesce(p, F.lit("")), rewrite(F.coalesce(m, F.lit(""))))), "")


# Elements removed with their content, and void elements removed.
BLOCKED_WITH_CONTENT = ["script", "style", "iframe", "object"]
BLOCKED_VOID = ["embed", "link", "meta"]


BODY_PATTERN = r"(?is)<body\b[^>]*>(.*)</body\s*>"
_TAG = "<[a-zA-Z/][^<>]*>"
#: Attributes removed from tags: handlers, and links that run code.
_HANDLER = r"""(?i)[\s/]+on[a-z0-9_-]+\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""
_SCRIPT_LINK = r"""(?i)[\s/]+(href|src)\s*=\s*("\s*javascript:[^"]*"|'\s*javascript:[^']*'|javascript:[^\s>]*)"""


def sanitize_html(c) -> Column:
    """H7: body only; blocked elements, ``on*`` attributes and ``javascript:`` links removed.

    Blocked elements go with their content, one that is never closed up to
    the end.  Attributes are looked for inside tags alone, so text that reads
    like one stays.  A regular-expression approximation of a DOM walk: it
    cleans stored pages for display and is not a security boundary.
    """
    s = col(c).cast("string")
    s = F.when(s.rlike(BODY_PATTERN), F.regexp_extract(s, BODY_PATTERN, 1)).otherwise(s)
    for t in BLOCKED_WITH_CONTENT:
        s = F.regexp_replace(s, rf"(?is)<{t}\b[^>]*>.*?(</{t}\s*>|\z)", "")
    s = F.regexp_replace(s, rf"(?is)</?({'|'.join(BLOCKED_VOID)})\b[^>]*>", "")
    texts = F.split(s, _TAG, -1)
    tags = F.transform(F.regexp_extract_all(s, F.lit(_TAG), 0), lambda t: F.regexp_replace(F.regexp_replace(t, _HANDLER, ""), _SCRIPT_LINK, ""))
    return F.array_join(F.zip_with(texts, tags, lambda text, tag: F.concat(text, F.coalesce(tag, F.lit("")))), "")
