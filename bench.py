"""Times the headline queries after a warm-up, the least of BENCH_RUNS (2) runs each, and their CPU seconds; prints one JSON line.

Queries that read ledgers or logs are timed over stored ones too (the names that end in `_stored`), so that making the input isn't
counted, and so is one pass over the ledger (`ledger_pass`).
"""

import json
import os
import time

from pyspark.sql import SparkSession

from loomstate import catalog
from loomstate.operators import rebuild
from loomstate.sources import frames
from loomstate.storage import stored

RUNS = int(os.environ.get("BENCH_RUNS", "2"))
HEADLINE = ["state_fold_affine", "state_fold_closed", "state_prefix_versions", "delta_coalesce", "three_way_merge", "select_highest_score", "effect_dedup", "effect_owed", "log_valid_prefix", "contract_outcomes", "plan_run_states", "plan_run_effects", "rebuild_states", "frame_read"]


def cpu_seconds() -> float:
    """User and system time of this process, the JVM that it started, and Python workers, those that ended too."""
    parent, used = {}, {}
    for entry in filter(str.isdigit, os.listdir("/proc")):
        try:
            with open(f"/proc/{entry}/stat") as f:
                fields = f.read().rsplit(")", 1)[1].split()
        except OSError:
            continue
        parent[int(entry)], used[int(entry)] = int(fields[1]), sum(map(int, fields[11:15]))

    def ours(pid: int) -> bool:
        return pid == os.getpid() or (pid in parent and ours(parent[pid]))

    return sum(t for pid, t in used.items() if ours(pid)) / os.sysconf("SC_CLK_TCK")


def main() -> None:
    where, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    records = stored(catalog.orders_run(spark, where).records(), "records")
    logs = stored(catalog.hurt_logs(spark, where), "logs")
    runs = {name: lambda name=name: catalog.QUERIES[name](spark, where) for name in HEADLINE}
    runs |= {"ledger_pass": lambda: records, "rebuild_states_stored": lambda: rebuild.states(records), "frame_read_stored": lambda: frames.read_logs(logs, "user_id")}
    took, cpu = {}, {}
    for name, run in runs.items():
        times = []
        for k in range(RUNS + 1):
            began, used = time.time(), cpu_seconds()
            run().write.format("noop").mode("overwrite").save()
            if k:
                times.append((time.time() - began, cpu_seconds() - used))
        took[name], cpu[name] = (round(min(x), 3) for x in zip(*times))
    headline = round(sum(took[n] for n in HEADLINE), 3)
    print(json.dumps({"metric": "total_seconds", "value": headline, "unit": "sec", "queries": took, "cpu_seconds": cpu, "runs": RUNS, "sf": where.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
