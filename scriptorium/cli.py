"""Command line: ``python -m scriptorium.cli COMMAND``. Every command prints JSON lines or writes where it is told."""

from __future__ import annotations

import argparse
import importlib
import json
import sys

from pyspark.sql import DataFrame

from .shared import local_session, table
from .sources.config import StageConfig

MODULES = ("build", "texts", "scores", "curate", "formats", "sources", "control", "integrity")


def queries() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"scriptorium.plans.{name}").QUERIES
    return out


VIEWS = {
    "waves": "profile_waves", "namespaces": "bundle_namespaces", "completion": "bundle_completion", "full-sources": "full_sources", "parameter-groups": "parameter_groups", "variants": "variant_plan", "protocols": "protocol_modes",
    "training": "training_batches", "frontier": "pareto_frontier", "scorecard": "scorecard_pivot", "failures": "failure_slices", "latency": "latency_card", "rewards": "reward_breakdown", "losses": "weighted_loss", "gates": "sample_gates",
    "acceptance": "bundle_gates", "leakage": "leakage_actions", "duplicates": "target_dedup", "near-duplicates": "near_dedup", "splits": "split_disjoint", "holdout": "holdout_exclusion", "mixture": "mixture_sample", "orphans": "p4_report", "totals": "run_totals", "publish": "published_copy",
}
"""Commands that show one query."""


def _about(command: str) -> object:
    if command == "sources":
        from .sources.families import SOURCES

        return {k: name for k, (name, _) in SOURCES.items()}
    if command == "schema":
        from .schemas import MANIFEST, columns_of

        return dict(columns_of(MANIFEST))
    import platform

    import pyarrow
    import pyspark

    return {"python": platform.python_version(), "pyspark": pyspark.__version__, "pyarrow": pyarrow.__version__}


def show(rows: DataFrame, limit: int) -> None:
    for line in rows.limit(limit).toJSON().toLocalIterator():
        print(line)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="scriptorium", description=__doc__)
    parser.add_argument("--data", default="/root/testdata/sf0.001", help="folder of parquet tables")
    parser.add_argument("--cores", default="*")
    parser.add_argument("--limit", type=int, default=50, help="rows to print")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run one query")
    run.add_argument("query")
    run.add_argument("--out", help="write parquet here instead of printing")
    for name, about in (("summary", "source registry by class"), ("plan", "sources in order, in waves"), ("audit", "what does not fit together in the registries"), ("route", "page routing"), ("validate", "Markdown findings"), ("assemble", "documents from pages"), ("score", "aggregated metrics"), ("rank", "variants by score")):
        commands.add_parser(name, help=about)
    build = commands.add_parser("build", help="build a dataset from the samples and registries of the data folder")
    build.add_argument("--stage", help="YAML file of the stage")
    build.add_argument("--runtime", help="YAML file laid over it")
    build.add_argument("--out", default="runs")
    build.add_argument("--shards", action="store_true")
    build.add_argument("--resume", action="store_true", help="leave the bundles of the ledger as they are")
    for name, query in VIEWS.items():
        commands.add_parser(name, help=f"the query {query}")
    layout = commands.add_parser("run-layout", help="where the records of a run lie")
    layout.add_argument("name")
    commands.add_parser("sources", help="registered sources and their families")
    commands.add_parser("schema", help="columns of a manifest")
    commands.add_parser("doctor", help="versions of what is used")
    args = parser.parse_args(argv)
    known = queries()
    if args.command in ("sources", "schema", "doctor"):
        print(json.dumps(_about(args.command)))
        return 0
    if args.command == "list":
        print("\n".join(known))
        return 0
    if args.command == "run" and args.query not in known:
        print(f"no query named {args.query}", file=sys.stderr)
        return 2
    spark = local_session("scriptorium", args.cores)
    try:
        if args.command == "build":
            from .plans import build as sources
            from .plans import pipeline

            config = StageConfig.from_yaml(args.stage, args.runtime) if args.stage else StageConfig()
            config.output_root = args.out
            samples = sources.once(spark, args.data, *[c for c in table(spark, args.data, "canonical_samples").columns if c not in ("sample_id", "built_at", "loaded_at")])
            result = pipeline.build(spark, config, samples.withColumn("source_id", sources._sid()), sources._bundle_sources(spark, args.data), shards=args.shards, resume=args.resume)
            print(json.dumps({"manifest": result.manifest_path, "shards": result.shard_path, "bundles": result.ledger.count()}))
            return 0
        if args.command == "run-layout":
            from .sources.runs import Run

            print(json.dumps(Run(spark, args.name).layout()))
            return 0
        names = VIEWS | {"summary": "registry_summary", "plan": "registry_plan_order", "audit": "registry_audit", "route": "route_pages", "validate": "validate_markdown", "assemble": "assemble_document", "score": "metric_aggregate", "rank": "rank_variants"}
        rows = known[args.query if args.command == "run" else names[args.command]](spark, args.data)
        if args.command == "run" and args.out:
            rows.write.mode("overwrite").parquet(args.out)
        else:
            show(rows, args.limit)
        return 0
    finally:
        spark.stop()


if __name__ == "__main__":
    sys.exit(main())
