"""Semi-structured answers (G1-G5): lenient JSON parsing and cleaning of
answer records, as column expressions over a table of answer texts.

Parsing is ``try_parse_json`` on the whole text, else on the greedy first
``{`` .. last ``}`` span, then ``from_json`` into the answer schema (values of
the wrong JSON type become NULL and are dropped like the reference drops
non-dict / non-list values).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Caps, kinds and default texts of the answer cleaning.
MAX_ARTIFACTS = 6
MAX_POINTS = 12
MAX_FOCUS_FILES = 4
MAX_ANALYSIS = 4
ARTIFACT_TYPES = ["html", "chart", "table"]
CHART_KINDS = ["bar", "line"]
DEFAULT_CHART_TITLE = "Visualización"
DEFAULT_TABLE_TITLE = "Detalle"
DEFAULT_RESPONSE = "Respuesta no disponible."
ANALYSIS_TITLE = "Análisis"
ANALYSIS_HTML_OPEN = (
    "<div><h3 style='margin:0 0 10px;font-size:15px;color:#111027;'>Análisis</h3>"
    "<ul style='margin:0;padding-left:18px;color:#3d394f;font-size:13px;line-height:1.5;'>"
)
ANALYSIS_HTML_CLOSE = "</ul></div>"

CHART = "struct<title:string,kind:string,data:array<struct<label:string,value:double>>>"
ARTIFACT = f"struct<type:string,title:string,html:string,chart:{CHART},rows:array<string>>"
# As parsed, a chart value may also be a number written as text.
_PARSED = {CHART: CHART.replace("value:double", "value:string")}
ANSWER_SCHEMA = (
    f"struct<response_text:string,response_html:string,artifacts:array<{ARTIFACT}>,focus_files:array<string>,"
    f"analysis:array<string>,chart:{CHART},table:array<string>>"
).replace(CHART, _PARSED[CHART])


def json_candidate(c) -> Column:
    """G1: the whole text when it is JSON, else the greedy ``{...}`` span; NULL when neither parses."""
    t = F.col(c) if isinstance(c, str) else c
    span = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return (
        F.when(F.try_parse_json(t).isNotNull(), t)
        .when((span != "") & F.try_parse_json(span).isNotNull(), span)
    )


def parse_answer(c) -> Column:
    """G1: the parsed answer struct (NULL when the text holds no JSON object)."""
    return F.from_json(json_candidate(c), ANSWER_SCHEMA)


def _blank(x: Column) -> Column:
    return x.isNull() | (F.trim(x) == "")


def _first_text(*texts: Column) -> Column:
    """The first text that is not blank."""
    return F.coalesce(*[F.when(~_blank(t), t) for t in texts])


def _points(chart: Column) -> Column:
    """Up to 12 points of a parsed chart, values as numbers."""
    data = F.coalesce(chart["data"], F.array().cast("array<struct<label:string,value:string>>"))
    return F.transform(F.slice(data, 1, MAX_POINTS), lambda p: F.struct(p["label"].alias("label"), p["value"].try_cast("double").alias("value")))


def _artifact(type_: Column, title: Column, html: Column, chart: Column, rows: Column) -> Column:
    return F.struct(
        type_.alias("type"), title.alias("title"), html.alias("html"), chart.alias("chart"), rows.alias("rows")
    )


def clean_artifacts(arts: Column) -> Column:
    """First 6 considered; known types only; blank html, charts of another kind
    and empty tables dropped; chart data and table rows cut to 12."""
    first = F.slice(F.coalesce(arts, F.array().cast(f"array<{ARTIFACT.replace(CHART, _PARSED[CHART])}>")), 1, MAX_ARTIFACTS)
    null_chart = F.lit(None).cast(CHART)
    null_rows = F.lit(None).cast("array<string>")
    null_text = F.lit(None).cast("string")

    def norm(a: Column) -> Column:
        kind = F.lower(F.trim(a["type"]))
        chart = F.struct(
            _first_text(a["chart"]["title"], a["title"], F.lit(DEFAULT_CHART_TITLE)).alias("title"),
            a["chart"]["kind"].alias("kind"), _points(a["chart"]).alias("data"),
        )
        return _artifact(
            kind, a["title"],
            F.when(kind == "html", a["html"]).otherwise(null_text),
            F.when(kind == "chart", chart).otherwise(null_chart),
            F.when(kind == "table", F.slice(a["rows"], 1, MAX_POINTS)).otherwise(null_rows),
        )

    def keep(a: Column) -> Column:
        return (
            ((a["type"] == "html") & ~_blank(a["html"]))
            | ((a["type"] == "chart") & a["chart"]["kind"].isin(CHART_KINDS))
            | ((a["type"] == "table") & (F.coalesce(F.size(a["rows"]), F.lit(0)) > 0))
        )

    return F.filter(F.transform(first, norm), keep)


def legacy_artifacts(ans: Column) -> Column:
    """Old ``analysis`` / ``chart`` / ``table`` fields as artifacts, in that order."""
    analysis = F.slice(F.coalesce(ans["analysis"], F.array().cast("array<string>")), 1, MAX_ANALYSIS)
    html = F.concat(
        F.lit(ANALYSIS_HTML_OPEN),
        F.array_join(F.transform(analysis, lambda x: F.concat(F.lit("<li>"), x, F.lit("</li>"))), ""),
        F.lit(ANALYSIS_HTML_CLOSE),
    )
    null_chart = F.lit(None).cast(CHART)
    null_rows = F.lit(None).cast("array<string>")
    null_text = F.lit(None).cast("string")
    a1 = F.when(F.size(analysis) > 0, F.array(_artifact(F.lit("html"), F.lit(ANALYSIS_TITLE), html, null_chart, null_rows)))
    ch = ans["chart"]
    chart_title = _first_text(ch["title"], F.lit(DEFAULT_CHART_TITLE))
    a2 = F.when(
        ch["kind"].isin(CHART_KINDS),
        F.array(_artifact(F.lit("chart"), chart_title, null_text,
                          F.struct(chart_title.alias("title"), ch["kind"].alias("kind"), _points(ch).alias("data")),
                          null_rows)),
    )
    a3 = F.when(
        F.coalesce(F.size(ans["table"]), F.lit(0)) > 0,
        F.array(_artifact(F.lit("table"), F.lit(DEFAULT_TABLE_TITLE), null_text, null_chart, F.slice(ans["table"], 1, MAX_POINTS))),
    )
    empty = F.array().cast(f"array<{ARTIFACT}>")
    return F.concat(F.coalesce(a1, empty), F.coalesce(a2, empty), F.coalesce(a3, empty))


def clean_answers(
    df: DataFrame,
    text_col: str = "text",
    summary_col: str | None = None,
    primary_col: str | None = None,
    fallback_col: str | None = None,
) -> DataFrame:
    """G1-G5 over a table of answer texts.

    Adds ``parse_error, response_text, response_html, artifacts, focus_files``.
    ``summary_col`` fills a blank text (G3), ``primary_col`` is the default
    focus file, ``fallback_col`` (artifacts from the query result, E7/E8)
    fills an answer left with no artifact (G5).
    """
    ans = parse_answer(F.col(text_col))
    summary = F.col(summary_col) if summary_col else F.lit(None).cast("string")
    primary = F.col(primary_col) if primary_col else F.lit(None).cast("string")
    arts = F.concat(clean_artifacts(ans["artifacts"]), legacy_artifacts(ans))
    if fallback_col:
        arts = F.when(F.size(arts) == 0, F.coalesce(F.col(fallback_col), arts)).otherwise(arts)
    focus = F.coalesce(F.when(F.size(ans["focus_files"]) > 0, ans["focus_files"]), F.when(primary.isNotNull(), F.array(primary)), F.array().cast("array<string>"))
    return df.select(
        "*",
        ans.isNull().alias("parse_error"),
        F.when(_blank(ans["response_text"]), F.coalesce(summary, F.lit(DEFAULT_RESPONSE))).otherwise(ans["response_text"]).alias("response_text"),
        F.when(_blank(ans["response_html"]), F.lit(None).cast("string")).otherwise(ans["response_html"]).alias("response_html"),
        F.slice(arts, 1, MAX_ARTIFACTS).alias("artifacts"),
        F.slice(focus, 1, MAX_FOCUS_FILES).alias("focus_files"),
    )


# Caps of the side panel and words that name a sheet in a KPI's context.
MAX_PANEL = {"insights": 4, "metrics": 4, "charts": 2}
SHEET_WORDS = ["hoja", "sheet"]
PANEL_SCHEMA = (
    "struct<title:string,input_kind:string,summary:string,insights:array<string>,"
    f"metrics:array<struct<label:string,value:string,context:string>>,charts:array<{_PARSED[CHART]}>>"
)


def clean_panels(df: DataFrame, text_col: str, title_col: str, kind_col: str, summary_col: str) -> DataFrame:
    """G3 for panel analyses: adds ``panel_error`` and ``panel``.

    A missing title, kind or summary takes the dataset's own; lists are cut to
    4 insights, 4 metrics and 2 charts; a KPI context that names a sheet is
    blanked.  Text without a JSON object is an error with an empty panel.
    """
    parsed = F.from_json(json_candidate(F.col(text_col)), PANEL_SCHEMA)
    p = F.col("__panel")

    def cut(name: str) -> Column:
        return F.slice(F.coalesce(p[name], F.array().cast(_panel_type(name))), 1, MAX_PANEL[name])

    def metric(m: Column) -> Column:
        context = F.lower(F.coalesce(m["context"], F.lit("")))
        names_sheet = F.lit(False)
        for word in SHEET_WORDS:
            names_sheet |= context.contains(word)
        return F.struct(m["label"].alias("label"), m["value"].alias("value"), F.when(names_sheet, F.lit("")).otherwise(m["context"]).alias("context"))

    panel = F.struct(
        F.coalesce(p["title"], F.col(title_col)).alias("title"), F.coalesce(p["input_kind"], F.col(kind_col)).alias("input_kind"),
        F.coalesce(p["summary"], F.col(summary_col)).alias("summary"), cut("insights").alias("insights"),
        F.transform(cut("metrics"), metric).alias("metrics"), cut("charts").alias("charts"),
    )
    return df.withColumn("__panel", parsed).withColumn("panel_error", p.isNull()).withColumn("panel", panel).drop("__panel")


def _panel_type(name: str) -> str:
    return {"insights": "array<string>", "metrics": "array<struct<label:string,value:string,context:string>>", "charts": f"array<{_PARSED[CHART]}>"}[name]
