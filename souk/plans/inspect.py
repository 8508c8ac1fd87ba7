"""Reading executed plans (for tests and for checking a plan by hand)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame, run: bool = True) -> str:
    """The final physical plan as text. With ``run`` the frame's own query
    execution is run (rows are counted, none are collected), so the plan is the
    one adaptive execution ended with (the plans it began with are printed too and left out)."""
    execution = df._jdf.queryExecution()
    if run:
        execution.toRdd().count()
    return without_initial_plans(execution.executedPlan().toString())


def without_initial_plans(plan: str) -> str:
    """The text of a plan without the subtrees of initial plans (of the query and of its
    subqueries): what stands at least as deep as their heading."""
    kept, deeper = [], None
    for line in plan.splitlines():
        at = len(line) - len(line.lstrip(" :|+-"))
        if deeper is not None and at >= deeper:
            continue
        deeper = at if "== Initial Plan ==" in line else None
        if deeper is None:
            kept.append(line)
    return "\n".join(kept)


def cross_products(plan: str) -> list[str]:
    """Operators that pair every row with every row."""
    return [line.strip() for line in plan.splitlines()
            if "CartesianProduct" in line or "BroadcastNestedLoopJoin" in line]


def unpartitioned_windows(plan: str) -> list[str]:
    """``Window`` operators without a PARTITION BY (all rows in one task). The plan
    prints ``Window [functions], [partition keys], [order keys]`` and leaves out
    empty lists, so such a window has one list after its functions, which holds sort
    orders -- or none."""
    out = []
    for line in plan.splitlines():
        m = re.search(r"\bWindow \[", line)
        if m:
            lists = _top_lists(line[m.end() - 1:])[1:]
            if not lists or re.search(r"\b(ASC|DESC) NULLS (FIRST|LAST)$", lists[0]):
                out.append(line.strip())
    return out


def _top_lists(text: str) -> list[str]:
    """Contents of the outermost bracketed lists."""
    out, depth, start = [], 0, 0
    for k, c in enumerate(text):
        if c == "[":
            depth += 1
            start = k + 1 if depth == 1 else start
        elif c == "]":
            depth -= 1
            if depth == 0:
                out.append(text[start:k].strip())
    return out
