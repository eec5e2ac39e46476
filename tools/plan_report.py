"""Summarise the physical plans of registered queries: exchanges, sorts, broadcast
joins, Python stages and scans (ReadSchema).

    python tools/plan_report.py /root/testdata/sf0.001 [name ...] > PLANS.md

Broadcast joins by size are off, as for tables beyond their limit; broadcasts
that remain are asked for by the operators, behind a check of size.
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pairgram.plans.registry import QUERIES  # noqa: E402
from pairgram.session import get_spark  # noqa: E402

#: Queries that fit trees while they are built.
FITS = {"gbt_predict", "gbt_regress", "split_importance"}
#: The stream runs to its end while the query is built.
OTHER = {"stream_turn_features"}


def formatted(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.001"
    names = argv[2:] or [n for n in QUERIES if n not in FITS | OTHER]
    spark = get_spark("plan-report")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    print("# Physical plan summary\n")
    print(f"Initial (pre-AQE) physical plans at `{sf_dir}`, broadcast by size off. For queries that write tables or checkpoints "
          f"while they are built, the plan after the last of them. Left out: {', '.join(sorted(FITS | OTHER))}.\n")
    print("| query | exchanges | sorts | broadcast joins | Python | scans (ReadSchema) |")
    print("| --- | --- | --- | --- | --- | --- |")
    for name in names:
        plan = formatted(QUERIES[name](spark, sf_dir))
        tree = plan[:plan.find("\n\n\n")]
        count = lambda pattern: len(re.findall(pattern, tree))
        scans = sorted({s if len(s) < 120 else s[:120] + "…" for s in re.findall(r"ReadSchema: (\S+)", plan)})
        print(f"| {name} | {count(r'(?<!Broadcast)(?<!Reused)Exchange ')} | {count(r'[- ]Sort ')} | {count('Broadcast(?:HashJoin|NestedLoopJoin)')} | "
              f"{'yes' if re.search('Python|InArrow|InPandas', tree) else ''} | {'; '.join(scans)} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
