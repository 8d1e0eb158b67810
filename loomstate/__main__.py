"""python -m loomstate: small runs to look at, and reading framed logs.

    run [STEPS]                 a straight plan of so many steps (20)
    demo [ARMS]                 fork, select the highest score, commit (3 arms)
    explore [ARMS] [EVALUATOR]  the same, with each arm's score and what became of it
    effects                     an effect of each class in both arms of a fork, and which of them reached the world
    inspect PATH                the frames of a framed log file (or a folder of them), and what is torn
    bench                       the headline queries, as bench.py has them
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.effects import CLASSES, READ
from .plans import Plan, PlanError, Run
from .plans.strategies import Strategy
from .sources import frames


def session() -> SparkSession:
    conf = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC"}
    spark = SparkSession.builder.appName("loomstate").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def listed(rows: DataFrame, what: str) -> None:
    """Prints all rows, as they come."""
    n = 0
    print(*rows.columns, sep="\t")
    for n, row in enumerate(rows.toLocalIterator(), 1):
        print(*row, sep="\t")
    print(f"{n} {what}")


def number(args: list[str], what: str, default: int) -> int:
    if not args:
        return default
    if not args[0].isdigit():
        raise PlanError(f"{what} must be a number: {args[0]}")
    return int(args[0])


def forked(arms: int, evaluator: str = "highest_score") -> Plan:
    values = [10 * (1 + (i * 2) % arms) for i in range(arms)]
    return Plan().set("total", 0).fork(*(Plan().add("total", v).set("score", v) for v in values)).select(evaluator).commit().add("committed", 1)


def with_effects() -> Plan:
    arm = lambda v: [p := Plan(), *(p.effect(c, c, v, reads_into="seen" if c == READ else None) for c in CLASSES), p.set("score", v)][0]
    return Plan().fork(arm(1), arm(2)).select("highest_score").commit()


def main(argv: list[str]) -> int:
    verb, args = (argv[0] if argv else "help"), argv[1:]
    if verb in ("help", "--help", "-h"):
        print(__doc__)
        return 0
    if verb == "bench":
        import bench

        bench.main()
        return 0
    if verb not in ("run", "demo", "explore", "effects", "inspect"):
        print(f"no such command: {verb}; try help", file=sys.stderr)
        return 2
    try:
        if verb == "inspect":
            if not args:
                raise PlanError("inspect needs the path of a log")
            spark = session()
            logs = spark.read.format("binaryFile").load(args[0]).select(F.col("path").alias("file"), F.col("content").alias("log"))
            read = frames.read_logs(logs, "file")
            torn = frames.torn_bytes(logs, read, "file")
            found = read.select("file", "ordinal", "offset", F.octet_length("payload").alias("bytes")).orderBy("file", "ordinal")
            listed(found, "frames")
            listed(torn.orderBy("file"), "logs")
            return 0
        plan = {
            "run": lambda: [p := Plan(), *(p.add("counter", 1) for _ in range(number(args, "STEPS", 20)))][0], "demo": lambda: forked(number(args, "ARMS", 3)),
            "explore": lambda: forked(number(args, "ARMS", 3), *args[1:2]), "effects": with_effects,
        }[verb]()
        run = Run(plan, session().range(1, 2).withColumnRenamed("id", "execution_id"))
    except PlanError as e:
        print(e, file=sys.stderr)
        return 1
    listed(run.states().orderBy("key"), "values")
    if verb in ("demo", "explore"):
        listed(run.futures().orderBy("arm").select("path", "status", "score", "steps", "cost_ms"), "futures")
    if verb == "effects":
        listed(Strategy("deterministic").issued(run).orderBy("path", "ordinal").select("effect_key", "class", "disposition", "released", "sink"), "effects")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
