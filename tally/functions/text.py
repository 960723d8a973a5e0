"""Text column functions (all JVM-side expressions, whole texts)."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._util import col


def slug(c, fallback: str | Column = "field") -> Column:
    """Slug of a header or name (A5): the ASCII letter/digit runs of the
    lower-cased text joined by ``_``; an empty result gives ``fallback``.

    Accented letters separate runs rather than fold: ``Año`` -> ``a_o``.
    """
    runs = F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), 0)
    fb = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return F.coalesce(F.nullif(F.array_join(runs, "_"), F.lit("")), fb)


def table_name(section) -> Column:
    """Table name of a section (A7): ``sheet_`` + slug, fallback ``sheet``."""
    return F.concat(F.lit("sheet_"), slug(section, "sheet"))


def label(c) -> Column:
    """Display label (C12): ``_`` to space, then title case.

    Title case uppercases the first letter after any non-letter, so
    ``col1x`` gives ``Col1X`` (plain ``initcap`` only splits on spaces).
    """
    pieces = F.regexp_extract_all(F.lower(F.regexp_replace(col(c), "_", " ")), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))),
        "",
    )


def _folded(ch: str) -> str:
    """Lower case, compatibility decomposition, combining marks dropped."""
    return "".join(x for x in unicodedata.normalize("NFKD", ch.lower()) if not unicodedata.combining(x))


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """The fold of every BMP character, by rule: one-letter folds and deletions as
    the two strings of a ``translate``, longer folds (ligatures, fractions) apart."""
    gone, src, dst, longer = [], [], [], {}
    for ch in (chr(cp) for cp in range(0x80, 0x10000) if not 0xD800 <= cp <= 0xDFFF):
        to = _folded(ch)
        if to == ch or not any(x.isascii() for x in to) and to:
            continue
        if len(to) > 1:
            longer[ch] = to
        elif to:
            src.append(ch)
            dst.append(to)
        else:
            gone.append(ch)
    return "".join(src) + "".join(gone), "".join(dst), longer


_FOLD_SRC, _FOLD_DST, _FOLD_LONGER = _fold_tables()


def _ranges(chars) -> str:
    """A regular-expression class of characters, neighbours as ranges."""
    out, run = [], []
    for cp in sorted(map(ord, chars)):
        if run and cp == run[1] + 1:
            run[1] = cp
        else:
            run = [cp, cp]
            out.append(run)
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in out) + "]"


_LONGER_CHARS = "".join(_FOLD_LONGER)
_LONGER_CLASS = _ranges(_FOLD_LONGER)


def fold_accents(c) -> Column:
    """Compatibility folding (E5): one ``translate`` for letters and marks; a text that holds
    characters that fold to several gets one replacement for each one that it holds."""
    x = col(c)
    folds = F.create_map(*[F.lit(t) for kv in _FOLD_LONGER.items() for t in kv])
    present = F.array_distinct(F.regexp_extract_all(x, F.lit(_LONGER_CLASS), F.lit(0)))
    rewritten = F.aggregate(present, x, lambda acc, k: F.replace(acc, k, F.element_at(folds, k)))
    # Deleting them shortens the text if there are any: much cheaper than a class of their ranges.
    holds = F.length(F.translate(x, _LONGER_CHARS, "")) < F.length(x)
    return F.translate(F.when(holds, rewritten).otherwise(x), _FOLD_SRC, _FOLD_DST)


NOT_QUESTION_TEXT = r"[^a-z0-9_ ]+"


def normalize_text(c) -> Column:
    """Question folding (E5): lower, fold, other characters to one space.  Not trimmed."""
    return F.regexp_replace(fold_accents(F.lower(col(c))), NOT_QUESTION_TEXT, " ")


#: Since the fold covers compatibility forms, the exact form is the same Column.
normalize_text_exact = normalize_text


def float_text(c) -> Column:
    """A double as Python writes it: ``12345678.9``, ``1e+16``, ``1e-05``."""
    x = col(c).cast("double")
    s = x.cast("string")
    plain = F.regexp_replace(s.cast("decimal(38,20)").cast("string"), r"0+$", "")
    plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
    mantissa = F.regexp_replace(F.substring_index(s, "E", 1), r"\.0$", "")
    power = F.substring_index(s, "E", -1).cast("int")
    sign = F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+"))
    scientific = F.concat(mantissa, sign, F.lpad(F.abs(power).cast("string"), 2, "0"))
    size = F.abs(x)
    return (
        # Within these bounds the text has no exponent, and nothing else is computed.
        F.when((size >= 1e-3) & (size < 1e7) | (x == 0), s)
        .when(F.isnan(x), F.lit("nan")).when(s.contains("Infinity"), F.when(x > 0, F.lit("inf")).otherwise(F.lit("-inf")))
        .when(~s.contains("E"), s).when((size >= 1e16) | (size < 1e-4), scientific).otherwise(plain)
    )


def cell_text(c, data_type: T.DataType) -> Column:
    """A cell as the reference writes it: Python's text of numbers and booleans."""
    x = col(c)
    if isinstance(data_type, T.BooleanType):
        return F.when(x, F.lit("True")).when(~x, F.lit("False"))
    if isinstance(data_type, T.DoubleType):
        return float_text(x)
    return x.cast("string")


# The characters Python's str.split() treats as whitespace.
PY_WHITESPACE_CLASS = (
    "[\\t\\n\\x0b\\x0c\\r\\x1c\\x1d\\x1e\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a"
    "\\u2028\\u2029\\u202f\\u205f\\u3000]"
)


def collapse_whitespace(c) -> Column:
    """``" ".join(s.split())``: runs of whitespace to one space, ends trimmed."""
    return F.trim(F.regexp_replace(col(c), PY_WHITESPACE_CLASS + "+", " "))


def csv_field(c) -> Column:
    """One CSV field, minimal quoting (quote when it holds , \" CR or LF); null is empty."""
    s = col(c).cast("string")
    quoted = F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(s.isNull(), F.lit("")).when(s.rlike('[,"\\r\\n]'), quoted).otherwise(s)


def csv_line(cols) -> Column:
    return F.concat_ws(",", *[csv_field(c) for c in cols])


# The truncation limit and marker of row chunks.
CHUNK_MAX_CHARS = 12000
TRUNCATION_MARKER = "\n[truncado para embedding]"


def truncate_text(c, max_chars: int = CHUNK_MAX_CHARS, marker: str = TRUNCATION_MARKER) -> Column:
    """D3: over the limit, the first ``max_chars`` characters plus a marker line."""
    x = col(c)
    return F.when(F.length(x) > max_chars, F.concat(F.substring(x, 1, max_chars), F.lit(marker))).otherwise(x)


def slug_name(value, fallback: str = "field") -> str:
    """Driver-side twin of ``slug`` for names the driver already holds."""
    import re

    return "_".join(re.findall("[a-z0-9]+", str(value).lower())) or fallback


def normalize_question(value: str) -> str:
    """Driver-side twin of ``normalize_text`` for one question string."""
    return re.sub(NOT_QUESTION_TEXT, " ", "".join(map(_folded, value)))
