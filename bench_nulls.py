"""Time the permutation null at the size of real treatments, through Spark, and print one JSON line.

Random treatments of 40,000 genes and 1,800 sets of 15 to 500 genes, 1,000
permutations each, on one core unless BENCH_CPUS says otherwise.
"""

from __future__ import annotations

import json
import os
import time

import numpy as np
import pandas as pd

from doseframe.operators import enrichment as E
from doseframe.operators.nulls import null_tails
from doseframe.session import build_session

GENES, SETS, PERMUTATIONS, TREATMENTS = 40_000, 1_800, 1_000, 3


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "1")
    spark = build_session("bench-nulls", f"local[{cpus}]", **{"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    rng = np.random.default_rng(7)
    sizes = np.clip(rng.lognormal(4.0, 0.7, SETS).astype(int), 15, 500)
    names = np.array([f"GENE{i}" for i in range(GENES)])
    members = pd.DataFrame({"pathway": np.repeat([f"set {i}" for i in range(SETS)], sizes), "gene": np.concatenate([names[rng.choice(GENES, k, replace=False)] for k in sizes])})
    ranked = pd.concat(
        [
            pd.DataFrame({"cell_line": "c", "drug": f"d{t}", "dose": "5.0", "gene": names, "metric": np.sort(rng.normal(size=GENES))[::-1], "position": rng.permutation(GENES), "n_genes": GENES})
            for t in range(TREATMENTS)
        ]
    )
    # Metric falls with the position, as a ranking has it.
    ranked["metric"] = -np.sort(-ranked["metric"].to_numpy().reshape(TREATMENTS, -1), axis=1).ravel()[ranked["position"] + GENES * np.repeat(range(TREATMENTS), GENES)]
    sets = spark.createDataFrame(members)
    frame = spark.createDataFrame(ranked).withColumn("position", E.F.col("position").cast("int"))
    scored = E.scored_members(E.with_sets(frame, sets)).cache()
    scored.count()
    seconds = {}
    # The first run also compiles and is not reported.
    for permutations in (1, 1, PERMUTATIONS):
        start = time.perf_counter()
        null_tails(scored, permutations).write.format("noop").mode("overwrite").save()
        seconds[permutations] = time.perf_counter() - start
    each = seconds[PERMUTATIONS] * min(int(cpus), TREATMENTS) / TREATMENTS
    print(json.dumps({"metric": "null_step_per_treatment_and_core", "value": round(each, 2), "unit": "sec", "members": len(members), "without_permutations": round(seconds[1] / TREATMENTS, 2)}))
    spark.stop()


if __name__ == "__main__":
    main()
