"""Summarise the executed physical plan of every registered query.

    python scripts/plan_report.py [sf_dir] > PLANS.md

Automatic broadcasts are switched off (``autoBroadcastJoinThreshold=-1``) so
the plans show the shape large inputs get; hinted broadcasts of bounded
tables remain. Each query is executed once, so the plan AQE ended with is shown.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

sys.path.insert(0, __file__.rsplit("/scripts/", 1)[0])

from souk.plans.registry import QUERIES  # noqa: E402
from souk.plans.inspect import physical_plan  # noqa: E402
from souk.session import build_session  # noqa: E402


def summary(plan: str) -> dict:
    lines = [ln for ln in plan.splitlines() if "ReusedExchange" not in ln]
    reused = sum("ReusedExchange" in ln for ln in plan.splitlines())
    exchanges = re.findall(r"Exchange (hashpartitioning\(([^)]*)\)|rangepartitioning|SinglePartition)",
                           "\n".join(lines))
    keys = []
    for full, inner in exchanges:
        if full.startswith("hashpartitioning"):
            cols = [re.sub(r"#\d+L?", "", c.strip()) for c in inner.split(",")[:-1]]
            keys.append("hash(" + ", ".join(cols) + ")")
        else:
            keys.append(full)
    return {
        "exchanges": Counter(keys),
        "reused": reused,
        "broadcasts": plan.count("BroadcastExchange"),
        "smj": plan.count("SortMergeJoin"),
        "bhj": plan.count("BroadcastHashJoin"),
        "windows": len(re.findall(r"\bWindow \[", plan)),
        "subqueries": len(set(re.findall(r"Subquery subquery#(\d+)", plan))),
        "expand": plan.count("Expand ["),
        "bucketed_scans": plan.count("Bucketed: true"),
    }


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    print("# PLANS\n")
    print(f"Executed physical plans of the registered queries on `{sf}`, automatic broadcasts off "
          "(the shape large inputs get). Generated by `scripts/plan_report.py`.\n")
    print("| Query | Exchanges (partitioning keys) | Reused | SMJ | BHJ | Bucketed scans | Windows | Scalar subqueries | Expand |")
    print("| --- | --- | --- | --- | --- | --- | --- | --- | --- |")
    for name, fn in QUERIES.items():
        s = summary(physical_plan(fn(spark, sf)))
        ex = "; ".join(f"{k} x{v}" if v > 1 else k for k, v in s["exchanges"].items()) or "none"
        ex = re.sub(r"spark_catalog\.default\.souk_[0-9a-f]+_\w+?\.", "", ex)
        print(f"| {name} | {ex} | {s['reused']} | {s['smj']} | {s['bhj']} | {s['bucketed_scans']} | {s['windows']} | "
              f"{s['subqueries']} | {s['expand']} |")


if __name__ == "__main__":
    main(sys.argv)
