"""Static analysis of diffs in arms: what each finds, whether it is there, and a report over all of them."""

from __future__ import annotations

import hashlib
import importlib.util
import json
import shutil
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospector.functions import diffs
from prospector.operators import reports

REPORT = "static-analysis-ablation-v1"


@dataclass(frozen=True)
class Availability:
    tool: str
    available: bool
    reason: str
    executable: str | None = None
    module: str | None = None
    probe_ms: float = 0.0


@dataclass(frozen=True)
class Result:
    """status: ok, unavailable, available_not_run or error."""

    arm: str
    status: str
    availability: Availability
    results: Mapping[str, Any] = field(default_factory=dict)
    metrics: Mapping[str, float] = field(default_factory=dict)
    error: str | None = None


@dataclass(frozen=True)
class Request:
    diff: str
    before: Mapping[str, str] = field(default_factory=dict)
    after: Mapping[str, str] = field(default_factory=dict)
    metadata: Mapping[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, value: Request | str, **more: Any) -> Request:
        return value if isinstance(value, Request) else cls(value, **more)


def probe(tool: str, executables: Sequence[str] = (), modules: Sequence[str] = (), which: Callable = shutil.which, spec: Callable = importlib.util.find_spec, now: Callable[[], float] = time.monotonic) -> Availability:
    """Whether a tool is there: an executable on the path, else a module; nothing is run."""
    began = now()
    took = lambda: round(1000 * (now() - began), 3)
    for name in executables:
        if place := which(name):
            return Availability(tool, True, f"executable {name}", executable=place, probe_ms=took())
    for name in modules:
        try:
            found = spec(name)
        except (ImportError, ValueError):
            found = None
        if found is not None:
            return Availability(tool, True, f"module {name}", module=name, probe_ms=took())
    return Availability(tool, False, "not installed", probe_ms=took())


def count_results(value: Any) -> int:
    """Items of all lists in a result; of nested mappings those of each value."""
    if isinstance(value, Mapping):
        return sum(map(count_results, value.values()))
    return len(value) if isinstance(value, Sequence) and not isinstance(value, (str, bytes)) else 0


class TextArm:
    """Always there: hunks, those that are not cosmetic, and the calls that they change."""

    name = "text_baseline"

    def availability(self) -> Availability:
        return Availability(self.name, True, "built in")

    def analyze(self, request: Request) -> Result:
        from pyspark.sql import SparkSession

        spark = SparkSession.getActiveSession()
        h = spark.createDataFrame([(request.diff,)], "d string").select(diffs.hunks(F.col("d")).alias("h"))
        row = h.select(diffs.substantive(F.col("h")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.transform("h", lambda x: diffs.changed_calls(x["lines"]))))).alias("calls")).first().asDict(recursive=True)
        found = {"hunks": row["s"]["hunks"], "changed_calls": row["calls"]}
        return Result(self.name, "ok", self.availability(), found, {"result_count": count_results(found), "input_hunks": row["s"]["input_hunks"], "filtered_hunks": row["s"]["filtered_hunks"], "external_processes": 0, "estimated_cost_usd": 0.0})


class ToolArm:
    """An optional tool: run only if it is there and a runner is given."""

    def __init__(self, name: str, executables: Sequence[str] = (), modules: Sequence[str] = (), run: Callable[[Request], Mapping[str, Any]] | None = None):
        self.name, self.executables, self.modules, self.run = name, executables, modules, run

    def availability(self) -> Availability:
        return probe(self.name, self.executables, self.modules)

    def analyze(self, request: Request) -> Result:
        there = self.availability()
        if not there.available or self.run is None:
            return Result(self.name, "available_not_run" if there.available else "unavailable", there, metrics={"result_count": 0, "external_processes": 0, "estimated_cost_usd": 0.0})
        found = self.run(request)
        return Result(self.name, "ok", there, found, {"result_count": count_results(found), "external_processes": 1, "estimated_cost_usd": 0.0})


#: Optional arms by name and what they need.
OPTIONAL = {"tree_sitter": ((), ("tree_sitter",)), "semgrep": (("semgrep",), ()), "codeql": (("codeql",), ()), "language_server": (("gopls", "pyright-langserver", "rust-analyzer"), ())}


def availability_report(arms: Sequence[Any] | None = None) -> dict[str, dict[str, Any]]:
    own = [TextArm(), *(ToolArm(n, *needs) for n, needs in OPTIONAL.items())] if arms is None else arms
    return {a.name: asdict(a.availability()) for a in own}


def ablation(arms: Sequence[Any], request: Request | str, **more: Any) -> dict[str, Any]:
    """Every arm on one request; names are unique, and an arm that raises fails alone."""
    if len({a.name for a in arms}) < len(arms):
        raise ValueError("arm names must be unique")
    asked, began, out = Request.of(request, **more), time.monotonic(), {}
    for arm in arms:
        try:
            out[arm.name] = arm.analyze(asked)
        except Exception as why:
            out[arm.name] = Result(arm.name, "error", arm.availability(), metrics={"result_count": 0, "external_processes": 0, "estimated_cost_usd": 0.0}, error=f"{type(why).__name__}: {why}")
    return {"schema_version": REPORT, "input_hash": "sha256:" + hashlib.sha256(json.dumps(asdict(asked), sort_keys=True).encode()).hexdigest(), "elapsed_ms": round(1000 * (time.monotonic() - began), 3), "arms": {n: asdict(r) for n, r in out.items()}, "summary": summary(out)}


def summary(results: Mapping[str, Result]) -> dict[str, Any]:
    names = lambda when: [n for n, r in results.items() if when(r)]
    total = lambda m: sum(r.metrics.get(m, 0) for r in results.values())
    return {
        "arm_count": len(results), "available": names(lambda r: r.availability.available), "unavailable": names(lambda r: not r.availability.available), "executed": names(lambda r: r.status == "ok"),
        "total_result_count": int(total("result_count")), "total_external_processes": int(total("external_processes")), "estimated_cost_usd": round(float(total("estimated_cost_usd")), 8),
    }


def hunk_symbols(hunks: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """hunks (seq, path, old_start, new_start, lines) with the enclosing symbol: of the newer file (path, text) where there is one, else of
    the older, and whether the hunk is cosmetic."""
    from prospector.operators.symbols import enclosing

    new = hunks.join(after.select("path"), "path", "left_semi").select("seq", "path", F.col("new_start").alias("line"), F.lit("after").alias("side"))
    old = hunks.join(after.select("path"), "path", "left_anti").select("seq", "path", F.col("old_start").alias("line"), F.lit("before").alias("side"))
    found = enclosing(new, after).unionByName(enclosing(old, before))
    marked = hunks.select("seq", diffs.cosmetic(F.col("lines"), F.col("path")).alias("cosmetic_only"))
    return found.join(marked, "seq")


def arms_table(spark, report: Mapping[str, Any]) -> DataFrame:
    """A report's arms as rows, for reports.arms_summary()."""
    rows = [(k, n, a["availability"]["available"], a["status"], int(a["metrics"].get("result_count", 0)), int(a["metrics"].get("external_processes", 0)), float(a["metrics"].get("estimated_cost_usd", 0.0))) for k, (n, a) in enumerate(report["arms"].items())]
    return reports.arms_summary(spark.createDataFrame(rows, "place int, name string, available boolean, status string, result_count long, external_processes long, cost double"))
