"""License scan: several hundred ordered regex signatures behind a keyword prefilter.

Texts are lower-cased (A-Z) and their words joined by single spaces.  A text
without any of a few anchors, which come from the signatures' forms, is done
after one scan.  For the others,
a signature runs only if a keyword that its own name holds occurs.  Every
match is an interval with a priority; sorted by start, longest first, a match
inside another of equal or higher priority is suppressed, which one running
maximum of ends per priority decides.

Signatures are written as families (names) times forms (phrases around a
name), so that hundreds of them stay readable.

Defined results: null text has no words and no labels; repeated rows are
judged one by one; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases and the labels they give.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label -> (keyword, names); names are regexes over single-spaced lower-case words, and each of them holds the keyword.
FAMILIES: dict[str, list[tuple[str, list[str]]]] = {
    "mit": [("mit", ["mit", "mit x11"]), ("expat", ["expat"])],
    "apache": [("apache", ["apache(?: software)?", "apache 2(?: 0)?"])],
    "gpl": [("gpl", ["gpl ?v?[123]?", "gnu gpl"]), ("general public", ["(?:gnu )?general public"])],
    "lgpl": [("lgpl", ["lgpl ?v?[23]?(?: 1)?", "gnu lgpl"]), ("lesser general", ["(?:gnu )?lesser general public"]), ("library general", ["(?:gnu )?library general public"])],
    "agpl": [("agpl", ["agpl ?v?3?", "gnu agpl"]), ("affero", ["(?:gnu )?affero general public"])],
    "bsd": [("bsd", ["bsd", "bsd [234] clause", "(?:simplified|modified|revised|new) bsd"])],
    "mpl": [("mozilla", ["mozilla(?: public)?"]), ("mpl", ["mpl ?[12]?(?: [01])?"])],
    "epl": [("eclipse", ["eclipse(?: public| distribution)?"])],
    "cddl": [("cddl", ["cddl"]), ("common development", ["common development and distribution"])],
    "cpl": [("common public", ["common public(?: attribution)?"])],
    "cc-by": [("creative", ["creative commons(?: attribution)?", "creative commons attribution share ?alike"])],
    "cc": [("cc by", ["cc by(?: (?:nc|sa|nd))*"])],
    "cc0": [("cc0", ["cc0(?: 1 0)?", "cc0 universal"])],
    "isc": [("isc", ["isc"]), ("internet systems", ["internet systems consortium"])],
    "zlib": [("zlib", ["zlib(?: libpng)?"])],
    "boost": [("boost", ["boost(?: software)?"])],
    "artistic": [("artistic", ["artistic(?: [12] 0)?", "perl artistic"])],
    "python": [("python", ["python(?: software foundation)?"]), ("psf", ["psf"])],
    "unlicense": [("unlicense", ["unlicense"])],
    "wtfpl": [("wtfpl", ["wtfpl"])],
    "openssl": [("openssl", ["openssl"])],
    "ofl": [("open font", ["(?:sil )?open font"])],
    "odbl": [("open database", ["open database"])],
    "eupl": [("european union", ["european union public"])],
    "ms-pl": [("microsoft", ["microsoft (?:public|reciprocal)"])],
    "sspl": [("server side", ["server side public"])],
    "bsl": [("business source", ["business source"])],
    "proprietary": [("proprietary", ["proprietary", "commercial proprietary"])],
}
_V = "(?: (?:version |v)?[0-9](?: [0-9])?)?"
#: (priority, anchors, form); N stands for a family's name and every match of the form holds one of the
#: anchors (regexes over single-spaced words).  Higher priorities say more.
FORMS = [
    (4, "spdx", "spdx license identifier N(?: only| or later)?(?: [0-9] [0-9])?"),
    (3, "licensed under|(?:released|distributed|available|published) under",
     f"(?:licensed|released|distributed|available|published) under (?:the |an? )?(?:terms (?:of|and conditions of) )?(?:the )?N(?: licen[sc]e)?{_V}"),
    (3, "subject to|(?:governed|covered) by", f"(?:subject to|governed by|covered by) (?:the )?(?:terms of )?(?:the )?N(?: licen[sc]e)?{_V}"),
    (3, "permitted under", f"(?:use|copying|redistribution) (?:is )?permitted under (?:the )?N{_V}"),
    (2, "licen[sc]", f"licen[sc]ed? (?:is |as )?(?:the )?N{_V}"),
    (2, "licen[sc]", f"N licen[sc]e{_V} or (?:any |at your option any )?later"),
    (1, "licen[sc]", f"N licen[sc]e{_V}"),
]
#: The base phrases' anchor.
_BASE_ANCHOR = "licen[sc]"


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str
    priority: int
    pattern: str
    #: Empty: texts are scanned whatever they hold.
    anchor: str = ""


def signatures() -> list[Signature]:
    """All signatures, in order."""
    return [
        Signature(label, keyword, priority, f"(?<= ){form.replace('N', '(?:' + name + ')', 1)}(?= )", anchor)
        for label, groups in FAMILIES.items()
        for keyword, names in groups
        for name in names
        for priority, anchor, form in FORMS
    ]


LEVELS = max(p for p, _, _ in FORMS)
_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Between the words of a text that is not lower-cased yet.
_RAW_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def anchored(text: Column, rules: list[Signature]) -> Column:
    """Whether a text as it stands can hold a base phrase or match a rule."""
    if not all(r.anchor for r in rules):
        return F.lit(True)
    anchors = dict.fromkeys([_BASE_ANCHOR, *(r.anchor for r in rules)])
    return text.rlike("(?i)" + "|".join(anchors).replace(" ", _RAW_SEPARATORS))


def spaced(text: Column) -> Column:
    """`` word word `` of a text, lower-cased A-Z."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), _SEPARATORS, " ")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")).cast("long")


def _spaces(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))).cast("long")


def base_places(norm: Column) -> tuple[Column, Column, Column]:
    """Count of base phrases in spaced words, and the first and last word index."""
    parts = F.split(norm, " (?=(?:" + "|".join(BASE) + ") )")
    n = (F.size(parts) - 1).cast("long")
    first = F.when(n > 0, _spaces(F.get(parts, F.lit(0))))
    last = F.when(n > 0, _spaces(norm) - 1 - _spaces(F.element_at(parts, -1)))
    return n, first, last


def matches(norm: Column, rules: list[Signature]) -> Column:
    """Array of (start, negated end, negated priority, label) of every match of every active rule."""
    by_keyword: dict[str, list[Signature]] = {}
    for r in rules:
        by_keyword.setdefault(r.keyword, []).append(r)
    none = F.array().cast("array<struct<s:int,e:int,p:int,label:string>>")

    def one(rule: Column) -> Column:
        # Text before each match and the match itself give the places.
        pattern = F.concat(F.lit("(?s)\\G(.*?)("), rule["pattern"], F.lit(")"))
        before, hit = F.regexp_extract_all(norm, pattern, F.lit(1)), F.regexp_extract_all(norm, pattern, F.lit(2))
        sizes = F.zip_with(before, hit, lambda b, h: F.struct(F.length(b).alias("b"), F.length(h).alias("h")))
        # A running end turns lengths into places.
        acc = F.aggregate(sizes, F.struct(F.lit(0).alias("at"), none.alias("out")),
                          lambda a, x: F.struct((a["at"] + x["b"] + x["h"]).alias("at"), F.array_append(a["out"], F.struct(
                              (a["at"] + x["b"]).alias("s"), (-(a["at"] + x["b"] + x["h"])).alias("e"), (-rule["priority"]).alias("p"), rule["label"].alias("label"))).alias("out")))
        return acc["out"]

    groups = []
    for keyword, own in by_keyword.items():
        table = F.array(*[F.struct(F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(r.label).alias("label")) for r in own])
        groups.append(F.when(F.contains(norm, F.lit(keyword)), table).otherwise(F.slice(table, 1, 0)))
    return F.flatten(F.transform(F.concat(*groups), one))


def unsuppressed(found: Column) -> Column:
    """(priority, label) pairs that survive containment; ``found`` sorted by start, longest, highest first."""
    start = F.struct(F.array_repeat(F.lit(-1), LEVELS).alias("ends"), F.array().cast("array<struct<p:int,label:string>>").alias("out"))

    def step(a, x):
        level, end = -x["p"], -x["e"]
        ends = F.transform(a["ends"], lambda m, k: F.when(k < level, F.greatest(m, end)).otherwise(m))
        pair = F.array(F.struct(level.alias("p"), x["label"].alias("label")))
        out = F.when(F.get(a["ends"], level - 1) >= end, a["out"]).otherwise(F.array_union(a["out"], pair))
        return F.struct(ends.alias("ends"), out.alias("out"))

    return F.aggregate(F.sort_array(found), start, step)["out"]


def scan(docs: DataFrame, text_col: str = "text", rules: list[Signature] | None = None) -> DataFrame:
    """``docs`` with ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels`` and ``score``."""
    rules = signatures() if rules is None else rules
    text = F.col(text_col)
    rows = docs.withColumn("__norm", F.when(anchored(text, rules), spaced(text)))
    norm = F.col("__norm")
    rows = rows.withColumn("__found", F.when(norm.isNotNull(), matches(norm, rules)))
    rows = rows.withColumn("__kept", F.when(F.size("__found") > 0, unsuppressed(F.col("__found"))))
    n, first, last = base_places(norm)
    base = F.array_compact(F.array(*[F.when(F.contains(norm, F.lit(f" {p} ")), F.lit(label)) for p, label in BASE.items()]))
    rows = rows.withColumn("__base", F.coalesce(base, F.array().cast("array<string>"))).withColumn("n_base", F.coalesce(n, F.lit(0).cast("long")))
    kept = F.coalesce(F.col("__kept"), F.array().cast("array<struct<p:int,label:string>>"))
    rows = rows.withColumn("first_word", first).withColumn("last_word", last)
    rows = rows.withColumn("base_labels", F.array_join(F.array_sort(F.array_distinct("__base")), ","))
    rows = rows.withColumn("labels", F.array_join(F.array_sort(F.array_union(F.col("__base"), F.transform(kept, lambda k: k["label"]))), ","))
    best = F.coalesce(F.array_max(F.transform(kept, lambda k: k["p"])), F.lit(0))
    rows = rows.withColumn("score", F.greatest(best / F.lit(float(LEVELS)), F.when(F.col("n_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0))))
    return rows.drop("__norm", "__found", "__kept", "__base")
