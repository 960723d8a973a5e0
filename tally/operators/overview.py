"""Executive overview (C1-C10): totals, dimensions, top-k rankings, KPIs,
shares and chart records.

The overview reads the profile (one row per column, catalog-sized) and runs
one Spark job per section for the rankings: every ranked dimension of a
section is aggregated in a single pass (rows exploded to ``(dimension,
label)``, partial aggregation map-side), and the top-k per dimension is a
``row_number() <= k`` that plans as ``WindowGroupLimit`` before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions._util import qcol
from ..functions.numbers import kpi_text
from ..functions.text import label
from .profile import semantic_type

# Overview sizes and texts.
MAX_SECTIONS = 4
MAX_METRICS = 4
MAX_DIMENSIONS = 3
RANKED_DIMENSIONS = 2
TOP_K = 5
MAX_KPIS = 4
KPIS_PER_SECTION = 2
KPI_SECTIONS = 2
SHARE_ITEMS = 3
MAX_INSIGHTS = 4
MAX_CHARTS = 2
COUNT_METRIC_LABEL = "Registros"


def metric_columns(prof: DataFrame) -> DataFrame:
    """Numeric columns with a value, with label, total, mean, type and a keep flag (first 4)."""
    w = Window.orderBy("pos")  # one row per column: catalog-sized
    return (
        prof.where(F.col("kind").isin("number", "boolean") & (F.col("non_nulls") > 0))
        .select(
            "pos",
            "column_name",
            label(F.col("column_name")).alias("label"),
            "total",
            "mean",
            semantic_type(F.col("column_name"), F.col("kind"), F.col("distinct"), F.col("non_nulls")).alias(
                "semantic_type"
            ),
        )
        .withColumn("metric_rank", F.row_number().over(w))
        .withColumn("kept", F.col("metric_rank") <= MAX_METRICS)
    )


def dimension_columns(prof: DataFrame, max_distinct_share: float | None = None) -> DataFrame:
    """Non-numeric columns with more than one distinct value; first 3 kept, first 2 ranked.

    ``max_distinct_share`` (off by default, as in the reference) also bars
    columns whose distinct count is above that share of their values, such
    as free text or identifiers stored as text, which make useless rankings
    on large tables.
    """
    w = Window.orderBy("pos")
    cond = ~F.col("kind").isin("number", "boolean") & (F.col("non_nulls") > 0) & (F.col("distinct") > 1)
    if max_distinct_share is not None:
        cond = cond & (F.col("distinct") <= F.col("non_nulls") * F.lit(float(max_distinct_share)))
    return (
        prof.where(cond)
        .select("pos", "column_name", label(F.col("column_name")).alias("label"), "distinct")
        .withColumn("dimension_rank", F.row_number().over(w))
        .withColumn("kept", F.col("dimension_rank") <= MAX_DIMENSIONS)
        .withColumn("ranked", F.col("dimension_rank") <= RANKED_DIMENSIONS)
    )


def base_metric(metrics: DataFrame) -> DataFrame:
    """First ``money_or_amount`` metric, else the first metric (before the cut to 4)."""
    key = F.struct((F.col("semantic_type") != "money_or_amount").alias("not_money"), F.col("pos"))
    return metrics.agg(
        F.min_by("column_name", key).alias("column_name"),
        F.min_by("label", key).alias("label"),
    )


def rank_dimensions(
    df: DataFrame,
    dimensions: Sequence[str],
    metric: str | None = None,
    k: int = TOP_K,
) -> DataFrame:
    """Top-k labels of several dimensions in one pass.

    With a metric: sum per label (null metric skipped, an all-null group
    sums to 0.0); without: count of rows.  Null labels are dropped.  Ties are
    ordered by label.  Output: ``dimension, rank, label, value``.
    """
    items = F.array(
        *[F.struct(F.lit(d).alias("dimension"), qcol(d).cast("string").alias("label")) for d in dimensions]
    )
    cols = [F.inline(items)]
    if metric is not None:
        cols.append(qcol(metric).cast("double").alias("__m"))
    long = df.select(*cols).where(F.col("label").isNotNull())
    if metric is not None:
        agg = long.groupBy("dimension", "label").agg(F.coalesce(F.sum("__m"), F.lit(0.0)).alias("value"))
    else:
        agg = long.groupBy("dimension", "label").agg(F.count(F.lit(1)).cast("double").alias("value"))
    w = Window.partitionBy("dimension").orderBy(F.col("value").desc(), F.col("label").asc())
    return agg.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "dimension", "rank", "label", "value"
    )


def top_k(df: DataFrame, dimension: str, metric: str | None = None, k: int = TOP_K) -> DataFrame:
    """C4/C5 for one dimension: ``orderBy(desc).limit(k)`` (``TakeOrderedAndProject``)."""
    base = df.select(qcol(dimension).cast("string").alias("label"), *([qcol(metric).cast("double").alias("__m")] if metric else []))
    base = base.where(F.col("label").isNotNull())
    if metric:
        agg = base.groupBy("label").agg(F.coalesce(F.sum("__m"), F.lit(0.0)).alias("value"))
    else:
        agg = base.groupBy("label").agg(F.count(F.lit(1)).cast("double").alias("value"))
    return agg.orderBy(F.col("value").desc(), F.col("label").asc()).limit(k)


OVERVIEW_SCHEMA = (
    "section string, rows bigint, "
    "metrics array<struct<column_name:string,label:string,total:double,mean:double,semantic_type:string>>, "
    "dimensions array<struct<column_name:string,label:string,distinct:bigint>>, "
    "rankings array<struct<dimension:string,metric:string,kind:string,data:array<struct<label:string,value:double>>>>"
)


def section_overview_record(df: DataFrame, section: str, prof: DataFrame, k: int = TOP_K) -> dict:
    """C7 for one section as a record: ``section, rows, metrics[], dimensions[], rankings[]``.

    The profile is catalog-sized: it is computed once and kept as a local
    relation, from which C1-C3 choose.  The rankings are one Spark job over
    the section (all ranked dimensions in one pass).
    """
    rows = prof.collect()
    local = df.sparkSession.createDataFrame(rows, prof.schema)
    # C1 and C2 in one small job; C3 and the row count are in what the driver then holds.
    picked = metric_columns(local).unionByName(dimension_columns(local), allowMissingColumns=True).orderBy("pos").collect()
    numeric = [r for r in picked if r["metric_rank"] is not None]
    metrics = [r for r in numeric if r["kept"]]
    dimensions = [r for r in picked if r["dimension_rank"] is not None and r["kept"]]
    base = min(numeric, key=lambda r: (r["semantic_type"] != "money_or_amount", r["pos"]), default={"column_name": None, "label": None})
    top: dict[str, list] = {d["column_name"]: [] for d in dimensions if d["ranked"]}
    if top:
        for r in rank_dimensions(df, list(top), base["column_name"], k).orderBy("rank").collect():
            top[r["dimension"]].append({"label": r["label"], "value": r["value"]})
    rankings = [
        {"dimension": d["label"], "metric": base["label"] or COUNT_METRIC_LABEL, "kind": "bar", "data": top[d["column_name"]]}
        for d in dimensions if top.get(d["column_name"])
    ]
    n_rows = max((r["rows"] or 0 for r in rows), default=0)
    shown = lambda row, names: {n: row[n] for n in names}
    return {
        "section": section,
        "rows": int(n_rows),
        "metrics": [shown(m, ("column_name", "label", "total", "mean", "semantic_type")) for m in metrics],
        "dimensions": [shown(d, ("column_name", "label", "distinct")) for d in dimensions],
        "rankings": rankings,
    }


def overview(sections: Sequence[tuple[str, DataFrame, DataFrame]], k: int = TOP_K, parallel: int = 4) -> DataFrame:
    """First 4 sections; empty sections are skipped but use a slot.

    ``sections`` is ``[(name, df, profile)]``; the result (a local relation:
    one row per kept section, with an ``ordinal``) feeds C8-C10.  Sections
    are independent, so their jobs are submitted from a few driver threads
    and run side by side on the cluster.
    """
    from concurrent.futures import ThreadPoolExecutor

    chosen = list(sections)[:MAX_SECTIONS]
    if not chosen:
        raise ValueError("no sections")
    spark = chosen[0][1].sparkSession
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        records = list(pool.map(lambda s: section_overview_record(s[1], s[0], s[2], k), chosen))
    kept = [dict(r, ordinal=i) for i, r in enumerate(records) if r["rows"] > 0]
    return spark.createDataFrame(kept, OVERVIEW_SCHEMA + ", ordinal int")


def kpis(ov: DataFrame) -> DataFrame:
    """Up to 2 KPIs from each of the first 2 sections, 4 in all.

    Prefer money / metric columns, else anything but quantity.  Value text
    by C11, with ``$`` for money.
    """
    w_sec = Window.orderBy("ordinal")
    first = ov.withColumn("__sec_rank", F.row_number().over(w_sec)).where(F.col("__sec_rank") <= KPI_SECTIONS)
    m = first.select("ordinal", F.posexplode("metrics").alias("mpos", "m"))
    preferred = F.col("m.semantic_type").isin("money_or_amount", "metric")
    has_pref = F.max(preferred.cast("int")).over(Window.partitionBy("ordinal")) > 0
    m = m.withColumn("__use", F.when(has_pref, preferred).otherwise(F.col("m.semantic_type") != "quantity"))
    m = m.where("__use").withColumn("__r", F.row_number().over(Window.partitionBy("ordinal").orderBy("mpos")))
    m = m.where(F.col("__r") <= KPIS_PER_SECTION)
    w_all = Window.orderBy("ordinal", "mpos")
    return (
        m.withColumn("kpi_rank", F.row_number().over(w_all))
        .where(F.col("kpi_rank") <= MAX_KPIS)
        .select(
            "kpi_rank",
            F.col("m.label").alias("label"),
            kpi_text(F.col("m.total"), F.col("m.semantic_type") == "money_or_amount").alias("value"),
            F.lit("").alias("context"),
        )
    )


def _pct(x: Column) -> Column:
    return F.replace(F.format_number(x, 2), F.lit(","), F.lit(""))


# Insight texts.
DEFAULT_INSIGHT = "El archivo ya fue procesado y está listo para análisis conversacional."


def insights(ov: DataFrame) -> DataFrame:
    """From the first ranking of each of the first 2 sections.

    Shares are of the sum of the ranked items shown (not of the whole
    column); top 3, only when that sum > 0 and there are >= 2 items, else a
    sentence about the leader.  4 in all.
    """
    w_sec = Window.orderBy("ordinal")
    first = ov.withColumn("__sec_rank", F.row_number().over(w_sec)).where(F.col("__sec_rank") <= KPI_SECTIONS)
    r = first.where(F.size("rankings") > 0).select("ordinal", "section", F.col("rankings")[0].alias("r"))
    r = r.select(
        "ordinal", "section", F.col("r.metric").alias("metric"), F.col("r.data").alias("data"),
        F.aggregate(F.col("r.data"), F.lit(0.0), lambda acc, p: acc + p["value"]).alias("total"),
    )
    shared = (F.col("total") > 0) & (F.size("data") >= 2)
    items = r.select(
        "ordinal", "section", "metric", "total", shared.alias("shared"), F.posexplode("data").alias("ipos", "p")
    )
    share_text = F.concat(
        F.col("p.label"), F.lit(": "), _pct(F.col("p.value") / F.col("total") * 100), F.lit("% del total de "),
        F.col("metric"), F.lit("."),
    )
    leader_text = F.concat(
        F.lit("En "), F.col("section"), F.lit(", "), F.col("p.label"), F.lit(" destaca en "), F.col("metric"),
        F.lit(" con "), kpi_text(F.col("p.value")), F.lit("."),
    )
    items = items.where(F.when(F.col("shared"), F.col("ipos") < SHARE_ITEMS).otherwise(F.col("ipos") == 0))
    w_all = Window.orderBy("ordinal", "ipos")
    return (
        items.select("ordinal", "ipos", F.when(F.col("shared"), share_text).otherwise(leader_text).alias("text"))
        .withColumn("insight_rank", F.row_number().over(w_all))
        .where(F.col("insight_rank") <= MAX_INSIGHTS)
        .select("insight_rank", "text")
    )


def charts(ov: DataFrame) -> DataFrame:
    """A bar chart per first ranking of the first 2 sections, long form.

    Output: ``chart_rank, title, kind, point, label, value``.
    """
    w_sec = Window.orderBy("ordinal")
    first = ov.withColumn("__sec_rank", F.row_number().over(w_sec)).where(F.col("__sec_rank") <= KPI_SECTIONS)
    r = first.where(F.size("rankings") > 0).select("ordinal", F.col("rankings")[0].alias("r"))
    r = r.withColumn("chart_rank", F.row_number().over(Window.orderBy("ordinal"))).where(F.col("chart_rank") <= MAX_CHARTS)
    return r.select(
        "chart_rank",
        F.concat(F.col("r.dimension"), F.lit(" por "), F.col("r.metric")).alias("title"),
        F.col("r.kind").alias("kind"),
        F.posexplode("r.data").alias("point", "p"),
    ).select("chart_rank", "title", "kind", (F.col("point") + 1).alias("point"), F.col("p.label").alias("label"), F.col("p.value").alias("value"))
