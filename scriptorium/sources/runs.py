"""The records of a run on any file system: layout, manifest, heartbeat, summary, events, console log, flags, and where inputs of a run lie."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .archives import file_system
from .sinks import write_json


def utc_now() -> str:
    """The time as text in UTC, with a Z."""
    return datetime.now(UTC).isoformat().replace("+00:00", "Z")


@dataclass(frozen=True)
class Run:
    """A run's folder: ``root/name`` with its records, ``control`` for flags, ``artifacts`` and ``scratch``."""

    spark: SparkSession
    name: str
    root: str = "runs"

    def at(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), self.name, *parts])

    def layout(self) -> dict[str, str]:
        files = {"manifest": "manifest.json", "heartbeat": "heartbeat.json", "summary": "summary.json", "console_log": "console.log", "events": "events.ndjson", "stop_flag": "control/STOP", "reload_flag": "control/RELOAD", "note": "control/NOTE.txt", "artifacts": "artifacts", "scratch": "scratch"}
        return {k: self.at(v) for k, v in files.items()}

    def manifest(self, payload: dict[str, Any]) -> None:
        write_json(self.spark, self.at("manifest.json"), {"experiment_id": self.name, **payload})

    def heartbeat(self, state: str, **metrics: float) -> None:
        write_json(self.spark, self.at("heartbeat.json"), {"experiment_id": self.name, "state": state, "latest_metrics": metrics, "updated_at": utc_now()})

    def summary(self, payload: dict[str, Any]) -> None:
        write_json(self.spark, self.at("summary.json"), {"experiment_id": self.name, **payload, "written_at": utc_now()})

    def _append(self, name: str, line: str) -> None:
        """A line more; a store that cannot append gets the log again as a whole (control logs are short)."""
        system, at = file_system(self.at(name))
        system.create_dir(at.rpartition("/")[0], recursive=True)
        try:
            with system.open_append_stream(at) as out:
                out.write(line.encode())
        except (NotImplementedError, OSError):
            old = b""
            if system.get_file_info(at).type == fs.FileType.File:
                with system.open_input_stream(at) as source:
                    old = source.read()
            with system.open_output_stream(at) as out:
                out.write(old + line.encode())

    def event(self, event_type: str, phase: str, stage: str, payload: dict[str, Any] | None = None) -> None:
        self._append("events.ndjson", json.dumps({"ts": utc_now(), "event_type": event_type, "phase": phase, "stage": stage, "payload": payload or {}}, sort_keys=True) + "\n")

    def log(self, message: str) -> None:
        self._append("console.log", f"{utc_now()} {message.rstrip()}\n")

    def flag(self, name: str) -> bool:
        """Whether a flag (STOP, RELOAD) is set."""
        system, at = file_system(self.at("control", name))
        return system.get_file_info(at).type == fs.FileType.File

    def counted(self, rows: DataFrame, label: str) -> tuple[DataFrame, Observation]:
        """``rows`` with counters that the engine fills while they are written: no pass of their own."""
        seen = Observation(f"{self.name}-{label}")
        return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def bundle_root(bundle_id: str, known: dict[str, str] | None = None, target: str | None = None) -> str:
    """Where a bundle that others build on lies: as told, else under the target; nowhere is an error."""
    if known and bundle_id in known:
        return known[bundle_id]
    if target:
        return f"{target.rstrip('/')}/{bundle_id}"
    raise RuntimeError(f"nothing tells where the bundle {bundle_id} lies")


def failure_manifest(uri: str | None) -> str:
    """The address of the failure manifest, which repair sources cannot do without."""
    if not uri:
        raise RuntimeError("repair sources need the address of a failure manifest")
    return uri


def serve_command(model: str, *, host: str = "0.0.0.0", port: int = 8000, length: int = 8192, memory: float = 0.9, sequences: int = 32, devices: int = 1, backend: str = "xgrammar") -> list[str]:
    """The words of the command that serves a model."""
    return ["vllm", "serve", model, "--host", host, "--port", str(port), "--gpu-memory-utilization", f"{memory:.2f}", "--max-model-len", str(length), "--max-num-seqs", str(sequences), "--tensor-parallel-size", str(devices), "--structured-outputs-config.backend", backend]


def quoted(words: list[str]) -> str:
    """Words as one line for a shell."""
    import shlex

    return shlex.join(words)


def probe_table(endpoints: DataFrame, chosen: list[str] | None = None) -> DataFrame:
    """``source_id, status`` of the chosen endpoints (all without a choice); nothing is asked over a network."""
    from ..operators.registry import probe_state

    rows = endpoints if chosen is None else endpoints.where(F.col("source_id").isin(chosen))
    return rows.select("source_id", "probe_policy", probe_state(F.col("probe_policy")).alias("status"))


def evaluation_stub(run: Run, protocol: str, scores: DataFrame) -> dict[str, Any]:
    """Report and scorecard of an evaluation: one row of scores per metric (metric, value), written as small documents."""
    card = {r["metric"]: r["value"] for r in scores.orderBy("metric").limit(10_000).collect()}
    report = {"protocol": protocol, "created_at": utc_now(), "scorecard": card, "status": "complete" if card else "empty"}
    write_json(run.spark, run.at("artifacts", "evaluation", "report.json"), report)
    write_json(run.spark, run.at("artifacts", "evaluation", "scorecard.json"), card)
    return report
