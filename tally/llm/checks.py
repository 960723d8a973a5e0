"""One query per operator, each over its whole table, with DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import load_table
from . import benchmark_suffixes, best_fit, collocations, hard_negatives, hilbert_shards, license_rules, quality_cascade, simhash_lsh, suffix_dedup, suffix_tree_lm, token_frames, toxicity_zstd, warc_revisits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle.strip()
        return fn

    return wrap


OP8_ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
v AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM v)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words FROM (SELECT doc_id, p, unnest([0, 1, 2]) AS k FROM r) GROUP BY doc_id),
s AS (SELECT v.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             length(regexp_replace(text, '[\x00-\x20!-@\[-`{-\x7F]+', '', 'g')) AS letters,
             length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS capitals
      FROM v LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_symbols > n_words
            OR 100 * n_dup_lines > 50 * n_lines OR 2 * letters < word_chars OR 10 * capitals > 7 * letters) AS kept
FROM b
"""


@query("op8_quality_rules", OP8_ORACLE)
def op8(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality_cascade.judge(docs)
    stat = lambda k: F.col("__q_" + k).alias(k)
    n, rep = F.col("__q_n_words"), F.col("__q_n_repeat_words")
    return rows.select(
        "doc_id", stat("n_words"), stat("word_chars"), stat("n_symbols"), stat("n_dup_lines"), stat("n_repeat_words"),
        ((n < 50) | (100 * rep > 50 * n)).alias("base_failed"), F.col("rejected_by").isNull().alias("kept"),
    )


@query("op7_best_fit_packing")
def op7(spark, sf_dir):
    return best_fit.pack(load_table(spark, sf_dir, "documents"), "byte_bpe_50k.json", end_id=2)


@query("op4_token_frames")
def op4(spark, sf_dir):
    return token_frames.round_trip(load_table(spark, sf_dir, "documents"), "word_bpe_49k.json", end_id=1)


@query("op2_hilbert_shards")
def op2(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        hilbert_shards.ordered(F.col("lang")).alias("__lang"), hilbert_shards.ordered(F.col("source")).alias("__source"), F.col("n_chars").cast("long").alias("__chars"),
    )
    bits = 6
    cells = hilbert_shards.quantiled(rows, {c: F.col(c) for c in ("__lang", "__source", "__chars")}, bits)
    out = hilbert_shards.shards(rows, cells, ["doc_id", "text_crc32", "size"], 8, bits)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


@query("op10_license_rules")
def op10(spark, sf_dir):
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = license_rules.scan(docs).withColumn("n_words", license_rules.n_words(F.col("text")))
    return rows.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


@query("op6_simhash_covering")
def op6(spark, sf_dir):
    rows = simhash_lsh.near_duplicates(load_table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return rows.select("doc_id", simhash_lsh.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query("op5_benchmark_suffixes")
def op5(spark, sf_dir):
    docs, benchmark = (load_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    m = F.col("matches")
    rows = benchmark_suffixes.scan(docs.select("doc_id", "text"), benchmark).withColumn("n_hit", benchmark_suffixes.n_hit(m))
    return rows.select(
        "doc_id", m["n_words"].alias("n_words"), "n_hit", F.size(m["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array(m["items"]), ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), m["longest"].alias("longest_match"),
    )


@query("op1_suffix_dedup")
def op1(spark, sf_dir):
    rows = suffix_dedup.remove_repeats(load_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.octet_length(F.coalesce(F.col("text"), F.lit("")))
    return rows.select(
        "doc_id", n.cast("long").alias("n_bytes"), (n - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op9_toxicity_zstd")
def op9(spark, sf_dir):
    docs, labels = (load_table(spark, sf_dir, t) for t in ("documents", "labels"))
    model = toxicity_zstd.train(toxicity_zstd.sample(docs, labels))
    rows = toxicity_zstd.score(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", toxicity_zstd.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))



def page_records(pages):
    """The crawl that ``pages`` stands for: each page's response at the time of its id and a
    not-modified revisit of it 5000 later, whose tag is stale on every seventh page."""
    tag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    stale = F.col("page_id") % 7 == 0
    header = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    response = F.map_from_entries(F.array(
        header("content-type", F.lit("text/html")), header("etag", tag), header("date", F.col("page_id").cast("string")),
        header("content-length", F.octet_length("html").cast("string"))))
    revisit = F.map_from_entries(F.array(
        header("etag", F.when(stale, F.lit('"stale"')).otherwise(F.concat(F.lit("W/"), tag))), header("date", (F.col("page_id") + 5000).cast("string")),
        header("content-length", F.lit("0")), header("cache-control", F.lit("max-age=60"))))
    page = F.col("page_id")
    first = pages.select((2 * page).alias("record_id"), "url", page.cast("long").alias("time"), F.lit("response").alias("kind"), response.alias("headers"), F.col("html").alias("body"))
    again = pages.select(
        (2 * page + 1).alias("record_id"), "url", (page + 5000).cast("long").alias("time"), F.lit("revisit").alias("kind"), revisit.alias("headers"), F.lit(None).cast("string").alias("body"))
    return first.unionByName(again)


OP3_ORACLE = r"""
WITH u AS (SELECT *, regexp_replace(split_part(url, '#', 1), '^[A-Za-z]+://((www|WWW|m|M)[.])?', '') AS r FROM pages),
q AS (SELECT *, split_part(r, '?', 1) AS place, list_filter(string_split(substr(r, length(split_part(r, '?', 1)) + 2), '&'),
             lambda x: x <> '' AND NOT (lower(split_part(x, '=', 1)) = 'ref' OR regexp_full_match(lower(split_part(x, '=', 1)), 'utm_[a-z]+') AND contains(x, '='))) AS args FROM u),
n AS (SELECT *, CASE WHEN len(args) > 0 THEN place || '?' || array_to_string(args, '&') ELSE place END AS whole FROM q),
p AS (SELECT page_id, html, md5(html) AS sum, regexp_replace(CASE WHEN contains(whole, '/') OR contains(whole, '?')
             THEN lower(split_part(split_part(whole, '/', 1), '?', 1)) || substr(whole, length(split_part(split_part(whole, '/', 1), '?', 1)) + 1) ELSE lower(whole) END, '(/+|[.]html?)$', '') AS canonical_url FROM n),
a AS (SELECT page_id, canonical_url, sum, page_id % 7 <> 0 AS fresh, page_id + 5000 AS at FROM p),
w AS (SELECT a.page_id, a.canonical_url, a.fresh AND a.sum = b.sum AS ok, b.page_id AS f, b.html
      FROM a ASOF JOIN p b ON a.canonical_url = b.canonical_url AND a.at > b.page_id)
SELECT 2 * page_id AS record_id, 'response' AS kind, canonical_url, true AS resolved, 2 * page_id AS refers_to, CAST(page_id AS VARCHAR) AS date,
       CAST(strlen(html) AS VARCHAR) AS content_length, CAST(NULL AS VARCHAR) AS cache_control, sum AS body_md5 FROM p
UNION ALL
SELECT 2 * page_id + 1, 'revisit', canonical_url, ok, CASE WHEN ok THEN 2 * f END, CASE WHEN ok THEN CAST(page_id + 5000 AS VARCHAR) END,
       CASE WHEN ok THEN CAST(strlen(html) AS VARCHAR) END, CASE WHEN ok THEN 'max-age=60' END, CASE WHEN ok THEN md5(html) END FROM w
"""


@query("op3_warc_revisits", OP3_ORACLE)
def op3(spark, sf_dir):
    rows = warc_revisits.resolve(page_records(load_table(spark, sf_dir, "pages")))
    h = F.col("merged_headers")
    return rows.select(
        "record_id", "kind", "canonical_url", "resolved", "refers_to", h["date"].alias("date"), h["content-length"].alias("content_length"),
        h["cache-control"].alias("cache_control"), F.md5(F.col("resolved_body").cast("binary")).alias("body_md5"),
    )


OP11_ORACLE = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM t),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3]) AS k FROM w))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 10),
s AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a AS b FROM c WHERE k = 3),
d AS (SELECT lang, phrase, max(b) AS b FROM s GROUP BY ALL),
x AS (SELECT c.* FROM c LEFT JOIN d USING (lang, phrase) WHERE b IS NULL OR 100 * b < 50 * a),
u AS (SELECT *, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:k], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS j FROM x)),
v AS (SELECT u.*, l.f AS l, r.f AS r, ((1000000::HUGEINT * u.a * u.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
      FROM u JOIN f l ON l.lang = u.lang AND l.phrase = lp JOIN f r ON r.lang = u.lang AND r.phrase = rp),
y AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT y.lang, row_number() OVER (PARTITION BY y.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n.n::BIGINT AS n, score
FROM y JOIN n USING (lang) QUALIFY rank <= 2000
"""


@query("op11_collocations", OP11_ORACLE)
def op11(spark, sf_dir):
    return collocations.collocations(load_table(spark, sf_dir, "documents"), longest=3, least=10, top=2000, cover=50)


@query("op13_suffix_tree_lm")
def op13(spark, sf_dir):
    return suffix_tree_lm.score(load_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP12_ORACLE = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op12_hard_negatives", OP12_ORACLE)
def op12(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(load_table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding"))
