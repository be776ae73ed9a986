"""What an executed plan did, as JSON: rows, times and other metrics of every operator of the final, adaptive plan."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame

#: Divisors that turn the units of Spark's time metrics into milliseconds.
_MS = {"timing": 1, "nsTiming": 1_000_000}


def _seq(items) -> Iterator:
    for i in range(items.size()):
        yield items.apply(i)


def _children(node) -> list:
    """The operators below, through the wrappers that adaptive execution adds."""
    kind = node.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return [node.executedPlan()]
    if kind.endswith("QueryStageExec"):
        return [node.plan()]
    return list(_seq(node.children()))


def _metrics(node) -> Iterator[tuple[str, str, int]]:
    it = node.metrics().iterator()
    while it.hasNext():
        pair = it.next()
        yield pair._1(), pair._2().metricType(), pair._2().value()


def _node(node) -> dict:
    out = {"node": node.nodeName().strip(), "text": node.simpleString(25)[:400], "rows": None, "ms": None, "metrics": {}, "children": []}
    for name, kind, value in _metrics(node):
        if kind in _MS:
            out["metrics"][name] = round(value / _MS[kind], 3)
        elif value >= 0:
            out["metrics"][name] = value
    # An operator inside a compiled stage has no clock of its own: the stage's stands at its head.
    times = [v for k, v in out["metrics"].items() if "ime" in k]
    out["rows"] = out["metrics"].get("numOutputRows")
    out["ms"] = max(times) if times else None
    out["children"] = [_node(c) for c in _children(node)]
    return out


def analyze(df: DataFrame) -> dict:
    """Runs df to its end, without collecting its rows, and gives {"seconds", "rows", "plan"}: plan is a tree of {"node", "text", "rows",
    "ms", "metrics", "children"}; rows and ms are null where the operator does not count them."""
    execution = df._jdf.queryExecution()
    began = time.perf_counter()
    rows = execution.toRdd().count()
    seconds = time.perf_counter() - began
    df.sparkSession._jsc.sc().listenerBus().waitUntilEmpty()
    return {"seconds": round(seconds, 6), "rows": rows, "plan": _node(execution.executedPlan())}


def analyze_json(df: DataFrame) -> str:
    return json.dumps(analyze(df))


def operators(analysis: dict) -> list[tuple]:
    """(depth, node, rows, ms) of each operator of an analysis, from the top."""
    out: list[tuple] = []

    def walk(node: dict, depth: int) -> None:
        out.append((depth, node["node"], node["rows"], node["ms"]))
        for c in node["children"]:
            walk(c, depth + 1)

    walk(analysis["plan"], 0)
    return out
