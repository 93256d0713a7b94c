"""Control-plane registries: selection, ranking, waves, audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ranks of next actions; all others come last.
NEXT_ACTIONS = {"prioritize_build": 0, "ingest_after_exact_core": 1, "ingest_for_hardcases": 2, "verify_license": 3, "verify_release_terms": 4}
LAST = 9


def action_rank(action: Column, ranks: dict[str, int] | None = None) -> Column:
    out = F.lit(LAST)
    for name, rank in (ranks or NEXT_ACTIONS).items():
        out = F.when(action == name, rank).otherwise(out)
    return out


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "A", 0).when(priority == "B", 1).when(priority == "C", 2).otherwise(LAST)


def select_sources(sources: DataFrame, status: DataFrame, *, watchlist: bool = False) -> DataFrame:
    """Sources with a status, without weak and unapproved ones unless the watchlist is allowed."""
    joined = sources.join(status.select("source_id", "current_status", "next_action"), "source_id")
    return joined if watchlist else joined.where("data_class <> 'weak_aux' and current_status = 'approved'")


def ranked_sources(selected: DataFrame, bundle_sources: DataFrame, ranks: dict[str, int] | None = None) -> DataFrame:
    """``source_id, plan_position``: sources in the order of the bundles that name them, the rest by rank of action, priority and id."""
    first = bundle_sources.groupBy("source_id").agg(F.min(F.struct("bundle_pos", "source_pos")).alias("at"))
    joined = selected.join(first, "source_id", "left")
    key = [F.col("at").isNull(), "at", action_rank(F.col("next_action"), ranks), priority_rank(F.col("ingestion_priority")), "source_id"]
    # the plan is a short list of registered sources
    return joined.select("source_id", (F.row_number().over(Window.orderBy(*key)) - 1).alias("plan_position"))


def waves(plan: DataFrame, size: int, position: str = "plan_position") -> DataFrame:
    """Waves of ``size`` in order; without a positive size one wave."""
    wave = F.floor(F.col(position) / size) if size > 0 else F.lit(0)
    return plan.withColumn("wave", wave.cast("int"))


def bundle_membership(bundles: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected sources of every bundle; a bundle of which none is selected gets all selected ones."""
    named = bundles.select("bundle_id", F.explode_outer("sources").alias("source_id"))
    kept = named.join(selected.select("source_id"), "source_id", "left_semi")
    bare = bundles.select("bundle_id").distinct().join(kept.select("bundle_id"), "bundle_id", "left_anti")
    everything = selected.agg(F.array_sort(F.collect_set("source_id")).alias("all")).scalar()
    return kept.select("bundle_id", "source_id").unionByName(bare.select("bundle_id", F.explode(everything).alias("source_id"))).distinct()


def pick_in_order(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The requested keys in their order, without unknown ones."""
    return wanted.join(known.select(key).distinct(), key).orderBy("pos")


def _finding(df: DataFrame, severity: str, code: str, subject: Column) -> DataFrame:
    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), subject.alias("subject"))


def audit(sources: DataFrame, status: DataFrame, endpoints: DataFrame, bundles: DataFrame, profiles: DataFrame) -> DataFrame:
    """``severity, code, subject``: everything in the registries that does not fit together."""
    s, st, e = (x.select("source_id").where("source_id is not null").distinct() for x in (sources, status, endpoints))
    sid = F.col("source_id")
    used = bundles.select("bundle_id", F.explode("sources").alias("source_id")).distinct()
    wanted = profiles.select("profile_id", F.explode("bundles").alias("bundle_id")).distinct()
    derivable = wanted.join(used, "bundle_id").select("profile_id", "source_id")
    groups = profiles.select("profile_id", F.explode("source_groups").alias("source_id")).distinct()
    parts = [
        _finding(s.join(st, "source_id", "left_anti"), "error", "missing_source_status", sid),
        _finding(s.join(e, "source_id", "left_anti"), "error", "missing_source_endpoint", sid),
        _finding(st.join(s, "source_id", "left_anti"), "error", "orphan_source_status", sid),
        _finding(e.join(s, "source_id", "left_anti"), "error", "orphan_source_endpoint", sid),
        _finding(endpoints.where("probe_policy = 'automated' and (coalesce(probe_method, '') = '' or coalesce(probe_url, '') = '')"), "error", "invalid_automated_probe", sid),
        _finding(endpoints.where("probe_policy = 'internal' and remote_fetchable"), "error", "invalid_probe_policy", sid),
        _finding(used.join(s, "source_id", "left_anti"), "error", "unknown_bundle_source", F.concat_ws("/", "bundle_id", "source_id")),
        _finding(wanted.join(bundles.select("bundle_id"), "bundle_id", "left_anti"), "error", "unknown_profile_bundle", F.concat_ws("/", "profile_id", "bundle_id")),
        _finding(groups.join(s, "source_id", "left_anti").join(derivable, ["profile_id", "source_id"], "left_anti").select("profile_id").distinct(), "error", "unresolvable_profile_sources", F.col("profile_id")),
        _finding(
            sources.join(endpoints.select("source_id", "probe_policy"), "source_id").where("data_class in ('exact_pair', 'trusted_aux') and probe_policy = 'manual'"), "warning", "manual_fetch_path", sid
        ),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def audit_summary(findings: DataFrame) -> DataFrame:
    return findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), (F.count_if(F.col("severity") == "error") == 0).alias("ok"))


def probe_state(policy: Column, reachable: Column | None = None) -> Column:
    """What a probe says: internal endpoints are skipped, manual ones are not tried, others are ok or failed where tried."""
    tried = F.lit("not_tried") if reachable is None else F.when(reachable, "ok").otherwise("failed")
    return F.when(policy == "internal", "skipped").when(policy == "manual", "manual").otherwise(tried)
