"""Queries of evaluation, selection and layout folds over the star schema, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import scoring as S
from ..shared import table


def _cards(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    computed = {S.P50: F.col("value"), S.P95: F.col("value"), "output_tokens_per_page": F.length("props"), "normalized_edit_similarity": F.col("value") / (F.col("value") + 100.0)}
    native = e.withColumn("native", F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("table_teds"), (F.col("user_id") % 10) / 10.0)).when(F.col("event_id") % 7 == 0, F.create_map(F.lit("normalized_edit_similarity"), F.lit(0.5))))
    return S.metric_cards(native, computed, "native", ["event_type"])


def metric_aggregate(spark: SparkSession, d: str) -> DataFrame:
    a = S.aggregate_metrics(_cards(spark, d), ["event_type"])
    return a.select("event_type", "metric", F.round("value", 6).alias("value"))


def latency_card(spark: SparkSession, d: str) -> DataFrame:
    return S.latency_card(_cards(spark, d), ["event_type"]).select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"), "sample_count")


def scorecard_pivot(spark: SparkSession, d: str) -> DataFrame:
    columns = {"page_overall": ("page_overall", "normalized_edit_similarity"), "table_teds": ("table_teds",), "rotation_score": ("rotation_score",), "p50": (S.P50,)}
    c = S.scorecard(S.aggregate_metrics(_cards(spark, d), ["event_type"]), ["event_type"], columns)
    return c.select("event_type", *[F.round(k, 6).alias(k) for k in columns])


def failure_slices(spark: SparkSession, d: str) -> DataFrame:
    return S.failure_slices(S.aggregate_metrics(_cards(spark, d), ["event_type"]), ["event_type"]).select("event_type", "slice", F.round("score", 6).alias("score"))


def block_f1(spark: SparkSession, d: str) -> DataFrame:
    """Block types a sample's features tell against those its slice tags tell."""
    s = table(spark, d, "canonical_samples").select("sample_id", "slice_tags", "has_heading", "has_list", "has_gfm_table", "has_display_math").distinct()
    seen = F.array_compact(F.array(F.when(F.col("has_heading"), "heading"), F.when(F.col("has_list"), "list"), F.when(F.col("has_gfm_table"), "table"), F.when(F.col("has_display_math"), "formula")))
    told = F.transform(F.filter("slice_tags", lambda t: t.isNotNull()), lambda t: F.when(F.contains(t, F.lit("formula")), "formula").when(F.contains(t, F.lit("table")) | F.contains(t, F.lit("cell")), "table").otherwise("list"))
    return s.select("sample_id", F.round(S.block_f1(seen, told), 6).alias("f1"))


_GOAL = {"quality_floor": 1000.0, "markdown_validity_floor": 0.0, "latex_validity_floor": 0.0, "max_memory_gb": 45.0, "max_relative_quality_drop": 0.3, "min_latency_gain": 0.15}
_REFERENCE = {"overall_score": 1500.0, "latency_ms": 40.0, "peak_memory_gb": 40.0}


def _variants(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(
        F.col("p_partkey").alias("variant_id"), F.round("p_retailprice", 2).alias("overall_score"), F.col("p_size").cast("double").alias("latency_ms"), (F.col("p_partkey") % 50 + 1).cast("double").alias("peak_memory_gb"), F.lit(1.0).alias("markdown_validity"), F.lit(1.0).alias("latex_validity")
    )


def rank_variants(spark: SparkSession, d: str) -> DataFrame:
    v = S.variant_scores(_variants(spark, d), _REFERENCE, _GOAL)
    return v.select("variant_id", F.round("score", 6).alias("score"), F.round("quality_retention", 6).alias("quality_retention"), "passes_floors")


def pareto_frontier(spark: SparkSession, d: str) -> DataFrame:
    return S.pareto_frontier(_variants(spark, d), "overall_score", ("latency_ms", "peak_memory_gb"), "variant_id").select("variant_id", "overall_score", "latency_ms", "peak_memory_gb")


def reward_breakdown(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", "value")
    kinds = e.select("event_type").distinct().withColumn("weight", (F.length("event_type") - 3) / 4.0)
    terms = S.reward_terms(e, by=["day"], signal="event_type", value="value", weights=kinds, clip=1.0)
    return terms.select("day", "event_type", F.round("term", 6).alias("term"))


def weighted_loss(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(S.weighted_mean(F.col("l_discount"), F.col("l_quantity")), 8).alias("loss"))
    return r


def shifted_targets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    rows = S.next_step_loss(e, key="user_id", order="event_id", value="value", steps=2)
    return rows.groupBy("user_id").agg(F.count("ahead_1").alias("one"), F.count("ahead_2").alias("two"), F.round(F.sum(F.abs(F.col("value") - F.col("ahead_1"))), 4).alias("step_change"))


def group_first_n(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").withColumns({"lr_scale": F.when(F.startswith("p_type", F.lit("STANDARD")), 0.5).when(F.startswith("p_type", F.lit("SMALL")), 0.75).otherwise(1.0), "decay": ~F.endswith("p_brand", F.lit("1"))})
    return S.first_names(p, ["lr_scale", "decay"], "p_name", "p_size")


def entity_runs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    r = L.runs(e, key="user_id", order=["ts", "event_id"], label="event_type", chunk=F.date_trunc("week", "ts"))
    return r.groupBy("user_id", "run", "event_type").agg(F.count(F.lit(1)).alias("size"), F.min("event_id").alias("first_event"))


def ocr_lines(spark: SparkSession, d: str) -> DataFrame:
    """Order items laid out as boxes on a page, read back as lines of text."""
    item = table(spark, d, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") * 37 % 100).cast("double").alias("x0"), (F.col("l_quantity") * 4).cast("double").alias("y0"), (F.col("l_quantity") * 4 + 12).cast("double").alias("y1"), F.concat("l_returnflag", F.col("l_linenumber").cast("string")).alias("text")
    )
    words = item.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("x0", "y0", "y1", "text"))).alias("words"))
    return words.select("l_orderkey", F.array_join(L.text_lines(F.col("words")), "\n").alias("page"))


def stem_pairing(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "canonical_samples").select("sample_id", F.explode("asset_names").alias("member")).where("member is not null").distinct()
    from ..functions.text import archive_stem

    left = s.select(archive_stem(F.col("member")).alias("stem"), "member", F.lit(0).alias("pos"))
    right = s.select(archive_stem(F.concat(F.lit("labels/"), F.col("sample_id"), F.lit(".txt"))).alias("stem"), F.concat(F.lit("labels/"), F.col("sample_id"), F.lit(".txt")).alias("member"), F.lit(0).alias("pos"))
    return L.pair_by_stem(left, right)


def coco_left_collect(spark: SparkSession, d: str) -> DataFrame:
    o, i = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    rows = L.collect_children(o, i, "o_orderkey", F.concat(F.lit("- item_"), F.col("l_linenumber").cast("string")), "l_linenumber")
    return rows.select("o_orderkey", F.size("children").alias("n"), F.array_join("children", "\n").alias("regions"))


def suffix_join(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "canonical_samples").select(F.explode("asset_names").alias("member")).where("member is not null").distinct().select(F.concat(F.lit("archive/images/"), F.col("member")).alias("member"))
    names = table(spark, d, "source_registry").select(F.concat("source_id", F.lit("-00000001-page-0001.png")).alias("name")).distinct().unionByName(s.select(F.expr("right(member, 20)").alias("name")).distinct())
    return L.suffix_match(names.distinct(), s)


def main_file_choice(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("source", F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".tex")).alias("path"), "text").where("source is not null")
    return L.main_file(t, key="source")


def mean_by_grade(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.curation import by_grade

    s = table(spark, d, "supplier").withColumn("grade", F.get(F.array(*map(F.lit, "ABCD")), (F.col("s_suppkey") % 4).cast("int")))
    return by_grade(s, "grade", "s_acctbal").select("grade", F.round("mean", 4).alias("mean"), "n")


def lus_score(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.curation import weighted_score

    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 10000).alias("quality"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_nationkey") / 25.0).alias("speed"), F.lit(0.5).alias("footprint"))
    return s.select("s_suppkey", F.round(weighted_score({"quality": 0.6, "speed": 0.25, "footprint": 0.15}), 6).alias("lus"))


def windowed_events(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the streaming aggregate: events per hour and type."""
    from ..streaming.events import hourly_counts

    return hourly_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))


def price_summary(spark: SparkSession, d: str) -> DataFrame:
    """A plain star-schema aggregate: revenue by nation and order priority."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    revenue = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    per_order = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "o_orderpriority").agg(revenue.alias("r"), F.count(F.lit(1)).alias("k"))
    return per_order.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "o_orderpriority").agg(F.round(F.sum("r"), 2).alias("revenue"), F.sum("k").alias("items"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        metric_aggregate, latency_card, scorecard_pivot, failure_slices, block_f1, rank_variants, pareto_frontier, reward_breakdown, weighted_loss, shifted_targets, group_first_n,
        entity_runs, ocr_lines, stem_pairing, coco_left_collect, suffix_join, main_file_choice, mean_by_grade, lus_score, windowed_events, price_summary,
    )
}

_LONG = """c AS (SELECT event_id, event_type, value, length(props) AS tok, CASE WHEN event_id % 3 <> 0 AND event_id % 7 = 0 THEN 0.5 ELSE value / (value + 100.0) END AS sim, CASE WHEN event_id % 3 = 0 THEN (user_id % 10) / 10.0 END AS teds FROM events),
 agg AS (
  SELECT event_type, 'p50_latency_ms_per_page' AS metric, median(value)::DOUBLE AS value FROM c GROUP BY 1 UNION ALL SELECT event_type, 'p95_latency_ms_per_page', max(value) FROM c GROUP BY 1
  UNION ALL SELECT event_type, 'output_tokens_per_page', avg(tok) FROM c GROUP BY 1 UNION ALL SELECT event_type, 'normalized_edit_similarity', avg(sim) FROM c GROUP BY 1
  UNION ALL SELECT event_type, 'table_teds', avg(teds) FROM c WHERE teds IS NOT NULL GROUP BY 1 UNION ALL SELECT event_type, 'pages_per_second', 1000.0 / greatest(median(value), 1e-8) FROM c GROUP BY 1)"""
_V = "v AS (SELECT p_partkey AS variant_id, round(p_retailprice, 2) AS overall_score, p_size::DOUBLE AS latency_ms, (p_partkey % 50 + 1)::DOUBLE AS peak_memory_gb FROM part)"
_STEM = r"regexp_replace(regexp_replace({}, '^.*/', ''), '(?i)(\.gt|\.page)?\.(xml|txt|json|png|jpe?g|tiff?|bmp|gz)$', '')"
SQL: dict[str, str] = {
    "ocr_lines": """WITH RECURSIVE w AS (SELECT l_orderkey, CAST(l_linenumber * 37 % 100 AS DOUBLE) AS x, l_quantity * 4 AS y0, l_quantity * 4 + 12 AS y1, l_returnflag || l_linenumber AS t FROM lineitem),
 h AS (SELECT l_orderkey, greatest(10.0, 0.8 * median(y1 - y0)) AS least FROM w GROUP BY 1), o AS (SELECT w.*, (y0 + y1) / 2 AS y, least, row_number() OVER (PARTITION BY l_orderkey ORDER BY (y0 + y1) / 2, x, t) AS k FROM w JOIN h USING (l_orderkey)),
 f AS (SELECT l_orderkey, k, x, t, y AS cy, 1 AS line FROM o WHERE k = 1
  UNION ALL SELECT o.l_orderkey, o.k, o.x, o.t, CASE WHEN abs(o.y - f.cy) > least THEN o.y ELSE (f.cy + o.y) / 2 END, f.line + CASE WHEN abs(o.y - f.cy) > least THEN 1 ELSE 0 END FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.k = f.k + 1)
 SELECT l_orderkey, string_agg(l, chr(10) ORDER BY line) AS page FROM (SELECT l_orderkey, line, string_agg(t, ' ' ORDER BY x, t) AS l FROM f GROUP BY 1, 2) GROUP BY 1""",
    "metric_aggregate": f"WITH {_LONG} SELECT event_type, metric, round(value, 6) AS value FROM agg",
    "latency_card": "SELECT event_type, round(avg(value), 6) AS p50, round(max(value), 6) AS p95, count(*)::DOUBLE AS sample_count FROM events GROUP BY 1",
    "scorecard_pivot": f"""WITH {_LONG}, w AS (SELECT event_type, max(value) FILTER (metric = 'normalized_edit_similarity') AS sim, max(value) FILTER (metric = 'table_teds') AS teds, max(value) FILTER (metric = 'p50_latency_ms_per_page') AS p50 FROM agg GROUP BY 1)
 SELECT event_type, round(coalesce(sim, 0.0), 6) AS page_overall, round(coalesce(teds, 0.0), 6) AS table_teds, 0.0::DOUBLE AS rotation_score, round(coalesce(p50, 0.0), 6) AS p50 FROM w""",
    "failure_slices": f"""WITH {_LONG}, w AS (SELECT event_type, max(value) FILTER (metric = 'normalized_edit_similarity') AS sim, max(value) FILTER (metric = 'table_teds') AS teds FROM agg GROUP BY 1)
 SELECT event_type, s.slice, round(CASE s.slice WHEN 'merged_cell_tables' THEN coalesce(teds, 0.0) WHEN 'document_assembly' THEN coalesce(sim, 0.0) ELSE 0.0::DOUBLE END, 6) AS score
 FROM w, (VALUES ('formulas'), ('merged_cell_tables'), ('handwriting'), ('rotation'), ('graphics'), ('document_assembly')) s(slice)""",
    "block_f1": """WITH s AS (SELECT DISTINCT sample_id, slice_tags, has_heading, has_list, has_gfm_table, has_display_math FROM canonical_samples),
 b AS (SELECT sample_id, list_filter([CASE WHEN has_heading THEN 'heading' END, CASE WHEN has_list THEN 'list' END, CASE WHEN has_gfm_table THEN 'table' END, CASE WHEN has_display_math THEN 'formula' END], lambda x: x IS NOT NULL) AS p,
  list_distinct(list_transform(list_filter(slice_tags, lambda t: t IS NOT NULL), lambda t: CASE WHEN contains(t, 'formula') THEN 'formula' WHEN contains(t, 'table') OR contains(t, 'cell') THEN 'table' ELSE 'list' END)) AS r FROM s)
 SELECT sample_id, round(CASE WHEN r IS NULL THEN 0.0 WHEN len(p) = 0 AND len(r) = 0 THEN 1.0 WHEN len(list_intersect(p, r)) = 0 THEN 0.0 ELSE 2.0 * len(list_intersect(p, r)) / (len(p) + len(r)) END::DOUBLE, 6) AS f1 FROM b""",
    "rank_variants": f"""WITH {_V}, s AS (SELECT *, overall_score / 1500.0 AS qr, 40.0 / greatest(latency_ms, 1e-8) AS lg, 40.0 / greatest(peak_memory_gb, 1e-8) AS mg FROM v),
 p AS (SELECT *, overall_score >= 1000 AND peak_memory_gb <= 45 AND 1.0 - qr <= 0.3 AND lg - 1.0 >= 0.15 AS passes_floors FROM s)
 SELECT variant_id, round(CASE WHEN passes_floors THEN 0.55 * qr + 0.3 * lg + 0.15 * mg END, 6) AS score, round(qr, 6) AS quality_retention, passes_floors FROM p""",
    "pareto_frontier": f"""WITH {_V} SELECT * FROM v c WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.variant_id <> c.variant_id AND o.overall_score >= c.overall_score AND o.latency_ms <= c.latency_ms AND o.peak_memory_gb <= c.peak_memory_gb
 AND (o.overall_score > c.overall_score OR o.latency_ms < c.latency_ms OR o.peak_memory_gb < c.peak_memory_gb))""",
    "reward_breakdown": """WITH e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, value FROM events), g AS (SELECT day, event_type, count(value) AS n, avg(value) AS mu, stddev_pop(value) AS sd FROM e GROUP BY 1, 2),
 m AS (SELECT e.day, e.event_type, avg(greatest(-1.0, least(1.0, CASE WHEN n >= 4 THEN (value - mu) / greatest(sd, 1e-6) ELSE value END))) AS mean FROM e JOIN g ON e.day = g.day AND e.event_type = g.event_type GROUP BY 1, 2)
 SELECT day, event_type, round(mean * (length(event_type) - 3) / 4.0, 6) AS term FROM m WHERE abs(mean) >= 0.02""",
    "weighted_loss": "SELECT l_returnflag, l_linestatus, round(sum(l_discount * l_quantity) / greatest(sum(l_quantity), 1.0), 8) AS loss FROM lineitem GROUP BY 1, 2",
    "shifted_targets": """WITH w AS (SELECT user_id, value, lead(value, 1) OVER k AS a1, lead(value, 2) OVER k AS a2 FROM events WINDOW k AS (PARTITION BY user_id ORDER BY event_id))
 SELECT user_id, count(a1) AS one, count(a2) AS two, round(sum(abs(value - a1)), 4) AS step_change FROM w GROUP BY 1""",
    "group_first_n": """WITH p AS (SELECT *, CASE WHEN starts_with(p_type, 'STANDARD') THEN 0.5 WHEN starts_with(p_type, 'SMALL') THEN 0.75 ELSE 1.0 END::DOUBLE AS lr_scale, NOT ends_with(p_brand, '1') AS decay FROM part)
 SELECT lr_scale, decay, CAST(sum(p_size) AS BIGINT) AS total, array_to_string(list_sort(list(DISTINCT p_name))[1:5], ',') AS names FROM p GROUP BY 1, 2""",
    "entity_runs": """WITH f AS (SELECT *, CASE WHEN lag(event_type) OVER k IS NOT DISTINCT FROM event_type AND row_number() OVER k > 1 THEN 0 ELSE 1 END AS c FROM events WINDOW k AS (PARTITION BY user_id ORDER BY ts, event_id)),
 r AS (SELECT *, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS run FROM f) SELECT user_id, run, event_type, count(*) AS size, min(event_id) AS first_event FROM r GROUP BY 1, 2, 3""",
    "stem_pairing": f"""WITH s AS (SELECT DISTINCT sample_id, unnest(asset_names) AS member FROM canonical_samples), l AS (SELECT {_STEM.format('member')} AS stem, min(member) AS left_member FROM s WHERE member IS NOT NULL GROUP BY 1),
 r AS (SELECT {_STEM.format("'labels/' || sample_id || '.txt'")} AS stem, min('labels/' || sample_id || '.txt') AS right_member FROM s WHERE member IS NOT NULL GROUP BY 1) SELECT stem, left_member, right_member FROM l JOIN r USING (stem)""",
    "coco_left_collect": """WITH i AS (SELECT l_orderkey, count(*) AS n, string_agg('- item_' || l_linenumber, chr(10) ORDER BY l_linenumber) AS regions FROM lineitem GROUP BY 1)
 SELECT o_orderkey, CAST(coalesce(n, 0) AS INT) AS n, coalesce(regions, '') AS regions FROM orders LEFT JOIN i ON o_orderkey = l_orderkey""",
    "main_file_choice": """WITH f AS (SELECT source, 'src/' || doc_id || '.tex' AS path, coalesce(CASE WHEN contains(text, '\\documentclass') THEN 10 ELSE 0 END + CASE WHEN contains(text, '\\begin{document}') THEN 8 ELSE 0 END + len(regexp_extract_all(text, '\\\\section')) + len(regexp_extract_all(text, '\\\\subsection')), 0) AS score FROM documents WHERE source IS NOT NULL)
 SELECT source, path, CAST(score AS INT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, length(path), path) AS k FROM f) WHERE k = 1""",
    "mean_by_grade": "SELECT ['A','B','C','D'][s_suppkey % 4 + 1] AS grade, round(avg(s_acctbal), 4) AS mean, count(s_acctbal) AS n FROM supplier GROUP BY 1",
    "lus_score": "SELECT s_suppkey, round(0.6 * (s_acctbal / 10000) + 0.25 * CASE WHEN s_suppkey % 5 <> 0 THEN s_nationkey / 25.0 END + 0.15 * 0.5, 6) AS lus FROM supplier",
    "windowed_events": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "price_summary": """SELECT n_name, o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    "suffix_join": """WITH s AS (SELECT DISTINCT 'archive/images/' || m AS member FROM (SELECT unnest(asset_names) AS m FROM canonical_samples) WHERE m IS NOT NULL),
 n AS (SELECT source_id || '-00000001-page-0001.png' AS name FROM source_registry UNION SELECT right(member, 20) FROM s)
 SELECT name, min(member) AS member FROM n JOIN s ON length(member) >= length(name) AND right(member, length(name)) = name GROUP BY 1""",
}
