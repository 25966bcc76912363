"""Write docs/PLANS.md: physical plans (explain "formatted") of key queries,
reduced to the operator tree plus each scan's read schema and filters.

usage: python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from passagekit.plans.registry import QUERIES  # noqa: E402
from passagekit.session import get_spark  # noqa: E402

NOTES = {
    "article_sections": "Article parsing: one projection + Generate, no Python. The only Exchange is the "
                        "round-robin spread of the one-row-group test file (`session.spread`); a large input "
                        "has none.",
    "dedup_staged": "Corpus build on the staged table: key rows only (pruned ReadSchema) until the final join "
                    "attaches ids to the text; the key tables with range numbers are the written scans.",
    "dedup_stats": "Counters on key rows; the hash aggregate is partial before its exchange.",
    "knn_flat": "Arrow kernel (MapInArrow) over the vector batches, partial WindowGroupLimit before the "
                "exchange on prompt_id.",
    "knn_sharded": "Same kernel, top-k per (prompt, shard) then per prompt.",
    "load_articles": "Static partition filter on file + broadcast semi join on the hit keys.",
    "rerank_lines": "Hits x lines equi-join, distance in the JVM, partial + final WindowGroupLimit.",
    "context_dataset": "Context aggregation reuses the window's partitioning on prompt_id.",
    "encode_hash": "Sparse encoder: the Arrow kernel returns each row's non-zero buckets, exploded in place (no exchange).",
}


def reduce(plan: str) -> str:
    tree, _, details = plan.partition("\n\n\n")
    keep = []
    for block in details.split("\n\n"):
        head = block.strip().split("\n")[0] if block.strip() else ""
        if "Scan" in head:
            lines = [ln for ln in block.split("\n")
                     if re.match(r"(\(\d+\) Scan|ReadSchema|PushedFilters|PartitionFilters|Location)", ln)]
            keep.append("\n".join(lines))
    return tree.strip() + ("\n\n" + "\n\n".join(keep) if keep else "")


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=16)
    out = ["# Physical plans", "", f"Generated by `tools/plans.py` on `{sf}` (plans before AQE re-planning; "
           "AQE may turn small shuffle joins into broadcasts at run time).", ""]
    for name, note in NOTES.items():
        if name == "dedup_staged":
            from passagekit.plans import corpus_build
            from passagekit.plans.context import ROWS_PER_FILE, Inputs
            df = corpus_build.dedup_staged(Inputs(spark, sf).staged, ROWS_PER_FILE)
        else:
            df = QUERIES[name](spark, sf)
        plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        plan = re.sub(r"file:/[^\]\s,]+", "<scratch>", plan)
        out += [f"## {name}", "", note, "", "```", reduce(plan), "```", ""]
    os.makedirs("docs", exist_ok=True)
    with open("docs/PLANS.md", "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
