"""Report plan shapes that do not scale: nested-loop and Cartesian joins, windows
without a partition, for every catalogue query.

    python tools/plans.py [--only a,b]
"""

from __future__ import annotations

import argparse
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loreweave.plans import registry
from loreweave.plans.tables import Tables
from loreweave.session import local_session

SHAPES = {
    "nested loop join": r"BroadcastNestedLoopJoin",
    "cartesian product": r"CartesianProduct",
    "window without partition": r"(?m)Window \[[^\n]*\)[^\n]*AS [^\n\[\]]*\], \[[^\n\[\]]* (?:ASC|DESC)[^\n\[\]]*\]$",
    "row-at-a-time python": r"BatchEvalPython",
}


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--only", default="")
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.001")
    a = ap.parse_args()
    spark = local_session("plans")
    spark.sparkContext.setLogLevel("ERROR")
    catalogue = registry.load()
    # Streams and iterative jobs run while they are built; their plans are not one plan.
    lazy = [n for n in catalogue if not n.endswith("_stream") and n != "communities"]
    for name in a.only.split(",") if a.only else lazy:
        df = catalogue[name].build(Tables(spark, a.sf_dir))
        plan = df._jdf.queryExecution().executedPlan().toString()
        found = [label for label, shape in SHAPES.items() if re.search(shape, plan)]
        if found:
            print(name, found)


if __name__ == "__main__":
    main()
