"""Running a plan over all executions at once, as one projection.

A plan's structure is the same for every execution, and so are the keys that it touches. The states of those keys
become columns, one row for each execution: a single aggregation. Steps are then arithmetic on columns, a fork names the
columns of its arms, a selection is a greatest struct, a merge compares columns; so the whole plan, however deep its
forks, is codegen over one row at a time without another shuffle. Keys that the plan doesn't touch never enter it.

Where the semantics leave a choice: arms are numbered on from fork to fork of the same future, so that a path names one
future only; the trunk is authoritative throughout; a nested commit merges into the future that
runs it, and its effects are released once all futures above are committed; a selection rejects failed futures too; an
execution whose commit meets a conflict under "abort" keeps its own state, and says so in `conflicted`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.effects import READ, effect_key, is_write_class, speculatable_class
from ..operators.selecting import LOWEST
from .plan import Plan, PlanError, Step

LIMIT = 2**63


def _inside(x) -> bool:
    return not isinstance(x, int) or -LIMIT <= x < LIMIT


def _long(x) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("long")


def _times(a, b):
    return 0 if (isinstance(a, int) and a == 0) or (isinstance(b, int) and b == 0) else b if isinstance(a, int) and a == 1 else a if isinstance(b, int) and b == 1 else a * b


def _plus(a, b):
    return b if isinstance(a, int) and a == 0 else a if isinstance(b, int) and b == 0 else a + b


class Run:
    """A plan over executions (execution_id and any columns that the plan's values name) and their states (execution_id, key, value).

    Repeated executions aren't allowed: execution_id is unique. Executions without states start empty; states of
    unknown executions are left out; a null value counts as an absent key. With executions None they are those of
    states, and `values` are aggregates over an execution's states for the plan to name: one aggregation, no join.

    journal: records of an earlier run of the plan that broke off (any prefix of each ledger). The run is resumed: what was read
    then is taken from the journal, only reads that it hasn't are asked of the world; operators.rebuild tells what is left to do.
    """

    def __init__(self, plan: Plan, executions: DataFrame | None, states: DataFrame | None = None, bias: int = 0, values: dict[str, Column] | None = None, journal: DataFrame | None = None):
        if not plan.steps:
            raise PlanError("an empty plan")
        if plan.fails():
            raise PlanError("the trunk fails")
        self.plan, self.bias, self._n = plan, bias, 0
        self.keys = plan.keys()
        self._futures: list[tuple] = []
        self._effects: list[tuple] = []
        self._conflicts: list[str] = []
        self._log: list[tuple] = [((), "opened", {})]
        env: dict[str, str] = {}
        pivot = lambda: {self._name(env, k): F.max(F.when(F.col("key") == k, F.col("value"))) for k in self.keys}
        self.df = executions
        if executions is None:
            of = {**(values or {}), **pivot(), self._fresh(): F.count("*")}
            self.df = states.groupBy("execution_id").agg(*(c.alias(n) for n, c in of.items()))
        elif states is None:
            self.df = executions.withColumns({self._name(env, k): F.lit(None).cast("long") for k in self.keys})
        elif self.keys:
            own = states.where(F.col("key").isin(self.keys)).groupBy("execution_id").agg(*(c.alias(n) for n, c in pivot().items()))
            self.df = executions.join(own, "execution_id", "left")
        self._journal = None
        if journal is not None:
            self._journal = self._fresh()
            reads = journal.where("kind = 'effect' and key is not null").select("execution_id", "sequence", "addend").distinct()
            past = reads.groupBy("execution_id").agg(F.map_from_entries(F.collect_list(F.struct("sequence", "addend"))).alias(self._journal))
            self.df = self.df.join(past, "execution_id", "left")
        self._final = self._block(plan, env, ())
        self._futures.insert(0, ((), None, None, None))

    def _name(self, env: dict[str, str], key: str) -> str:
        env[key] = self._fresh()
        return env[key]

    def _fresh(self) -> str:
        self._n += 1
        return f"_c{self._n}"

    def _add(self, columns: dict[str, Column]) -> None:
        if columns:
            self.df = self.df.withColumns(columns)

    def _flush(self, env: dict[str, str], maps: dict[str, tuple]) -> None:
        """Adds a column for each key that steps since the last flush have changed."""
        new = {}
        for key, (scale, addend) in maps.items():
            old = F.coalesce(F.col(env[key]), F.lit(0).cast("long"))
            changed = _long(addend) if isinstance(scale, int) and scale == 0 else _plus(_times(scale, old), addend)
            new[self._name(env, key)] = _long(changed)
        maps.clear()
        self._add(new)

    def _block(self, plan: Plan, env: dict[str, str], path: tuple[int, ...]) -> dict[str, str]:
        env, maps, ordinal, arms = dict(env), {}, 0, 0
        forked: dict | None = None

        def step(key: str, scale, addend) -> None:
            s, a = maps.get(key, (1, 0))
            both = (_times(s, scale), _plus(_times(a, scale), addend))
            if not all(map(_inside, both)):
                self._flush(env, maps)
                both = (scale, addend)
            maps[key] = both

        for s in plan.until_failure():
            if s.kind in ("set", "add", "compute", "emit"):
                step(s.key, s.scale, s.addend)
                self._log.append((path, "step", {"key": s.key, "scale": s.scale, "addend": s.addend}))
            elif s.kind == "sleep":
                self._log.append((path, "step", {}))
            elif s.kind == "effect":
                done = not path or speculatable_class(s.cls)
                result = _plus(_times(s.addend, 2), self.bias) if s.cls == READ else None
                read = {}
                if s.reads_into:
                    if self._journal:
                        result = F.coalesce(F.try_element_at(F.col(self._journal), F.lit(len(self._log)).cast("long")), _long(result))
                    read = {"key": s.reads_into, "scale": 0, "addend": result}
                    step(s.reads_into, 0, result)
                self._effects.append((path, ordinal, s, done, result))
                ordinal += 1
                self._log.append((path, "effect", read))
            elif s.kind == "fork":
                self._flush(env, maps)
                self._log.append((path, "fork", {"arms": len(s.arms), "arm": arms}))
                ends = [self._block(arm, env, (*path, i)) for i, arm in enumerate(s.arms, arms)]
                forked = {"arms": s.arms, "first": arms, "base": dict(env), "ends": ends, "won": None, "at": len(self._futures)}
                for i, arm in enumerate(s.arms, arms):
                    self._futures.append(((*path, i), arm, None, None))
                arms += len(s.arms)
            elif s.kind == "select":
                if forked is None:
                    raise PlanError("nothing to select from")
                self._select(s, forked, path)
            elif s.kind == "commit":
                if forked is None or forked["won"] is None:
                    raise PlanError("nothing is selected to commit")
                self._flush(env, maps)
                env = self._commit(s, forked, env, path)
                forked = None
        self._flush(env, maps)
        return env

    def _score(self, s: Step, arm: Plan, end: dict[str, str]) -> Column | None:
        """None if the evaluator refuses the arm; that is known from the plan alone."""
        head = F.coalesce(F.col(end[s.key]), F.lit(0).cast("long"))
        if arm.fails() or (s.name == "only_without_irreversible" and arm.irreversible_deferred(False)):
            return None
        if s.name == "lowest_score":
            return F.when(head == LOWEST, F.lit(LIMIT - 1)).otherwise(-F.greatest(head, F.lit(LOWEST + 1)))
        return {"cheapest": _long(-arm.cost_ms()), "first_by_identity": _long(0)}.get(s.name, head)

    def _select(self, s: Step, forked: dict, path: tuple[int, ...]) -> None:
        scores = [self._score(s, arm, end) for arm, end in zip(forked["arms"], forked["ends"], strict=True)]
        standing = [F.struct(x.alias("score"), F.lit(-i).alias("arm")) for i, x in enumerate(scores, forked["first"]) if x is not None]
        if not standing:
            raise PlanError("no viable future: all failed or were refused")
        won = self._fresh()
        best = standing[0] if len(standing) == 1 else F.greatest(*standing)
        self._add({won: -best["arm"]})
        forked["won"] = won
        self._log.append((path, "selected", {"arm": F.col(won)}))
        for i, x in enumerate(scores):
            name = self._fresh() if x is not None else None
            if name:
                self._add({name: _long(x)})
            self._futures[forked["at"] + i] = ((*path, forked["first"] + i), forked["arms"][i], name, (won, None))

    def _commit(self, s: Step, forked: dict, env: dict[str, str], path: tuple[int, ...]) -> dict[str, str]:
        """The winner's state merged with the state that its parent has now, both since the fork."""
        zero, won, base = F.lit(0).cast("long"), F.col(forked["won"]), forked["base"]
        read = lambda c: F.coalesce(c, zero)
        ours = {}
        for k in self.keys:
            ends = [e[k] for e in forked["ends"]]
            pick = F.col(ends[-1])
            for i, e in reversed(list(enumerate(ends[:-1]))):
                pick = F.when(won == forked["first"] + i, F.col(e)).otherwise(pick)
            ours[k] = self._fresh()
            self._add({ours[k]: pick if len(set(ends)) > 1 else F.col(ends[0])})
        # A key that the parent hasn't changed since the fork can't conflict.
        moved = [k for k in self.keys if env[k] != base[k]]
        clash = [(read(F.col(ours[k])) != read(F.col(base[k]))) & (read(F.col(env[k])) != read(F.col(base[k]))) & (read(F.col(ours[k])) != read(F.col(env[k]))) for k in moved]
        conflicted = self._fresh()
        self._add({conflicted: F.greatest(*clash) if len(clash) > 1 else clash[0] if clash else F.lit(False)})
        self._conflicts.append(conflicted)
        out: dict[str, str] = {}
        new = {}
        for k in self.keys:
            o, t = F.col(ours[k]), F.col(env[k])
            merged = F.when(read(o) == read(F.col(base[k])), F.coalesce(t, o)).otherwise(o) if k in moved else o
            new[self._name(out, k)] = F.when(F.col(conflicted), t if s.name == "abort" else o).otherwise(merged)
        self._add(new)
        changes = F.array(*(F.struct(F.lit(k).alias("key"), F.col(out[k]).alias("value"), F.col(out[k]).eqNullSafe(F.col(env[k])).alias("same")) for k in self.keys))
        self._log.append((path, "committed", {"arm": won, "policy": s.name, "changes": F.transform(F.filter(changes, lambda c: ~c["same"] & c["value"].isNotNull()), lambda c: F.struct(c["key"].alias("key"), c["value"].alias("value")))}))
        for i in range(len(forked["arms"])):
            p, arm, score, (w, _) = self._futures[forked["at"] + i]
            self._futures[forked["at"] + i] = (p, arm, score, (w, (conflicted, s.name)))
        return out

    # Results

    def _won(self, path: tuple[int, ...]) -> Column:
        """Whether a future and all above it, but for the trunk, were committed."""
        by = {p: of for p, _, _, of in self._futures}
        held = F.lit(True)
        for n in range(1, len(path) + 1):
            of = by[path[:n]]
            held = held & (self._committed(of, path[n - 1]) if of and of[1] else F.lit(False))
        return held

    @staticmethod
    def _committed(of: tuple, arm: int) -> Column:
        won, (conflicted, policy) = of
        return (F.col(won) == arm) & (F.lit(policy == "take_future") | ~F.col(conflicted))

    def states(self) -> DataFrame:
        """execution_id, key, value of the trunk in the end; keys that the plan doesn't touch aren't listed."""
        pairs = F.array(*(F.struct(F.lit(k).alias("key"), F.col(self._final[k]).alias("value")) for k in self.keys))
        return self.df.select("execution_id", F.explode(pairs).alias("p")).select("execution_id", "p.key", "p.value").where("value is not null")

    def futures(self) -> DataFrame:
        """execution_id, path, arm, status, failed, score, steps, cost_ms, deferred, performed, irreversible_deferred of each future but the trunk.

        A selection rejects all but its winner, those that failed too; failed keeps that they had."""
        rows = []
        for path, arm, score, of in self._futures[1:]:
            if of is None:
                status = F.lit("failed" if arm.fails() else "evaluable")
            else:
                after = F.when(self._committed(of, path[-1]), "committed").otherwise("evaluable") if of[1] else F.lit("evaluable")
                status = F.when(F.col(of[0]) == path[-1], after).otherwise("rejected")
            own = [e for e in self._effects if e[0] == path]
            n = [len(arm.until_failure()), arm.cost_ms(), sum(not e[3] for e in own), sum(e[3] for e in own), arm.irreversible_deferred(False)]
            rows.append(F.struct(
                F.lit(".".join(map(str, path))).alias("path"), F.lit(path[-1]).alias("arm"), status.alias("status"), F.lit(arm.fails()).alias("failed"), (F.col(score) if score else F.lit(None).cast("long")).alias("score"),
                *(_long(x).alias(c) for x, c in zip(n, ("steps", "cost_ms", "deferred", "performed", "irreversible_deferred"), strict=True)),
            ))
        if not rows:
            raise PlanError("the plan doesn't fork")
        return self.df.select("execution_id", F.explode(F.array(*rows)).alias("f")).select("execution_id", "f.*")

    def effects(self) -> DataFrame:
        """execution_id, effect_key, path, ordinal, class, op_name, args, disposition, result, released.

        released: a deferred effect of a future that was committed, with all above it; each is released once.
        """
        rows = []
        for path, ordinal, s, done, result in self._effects:
            at = F.array(*map(F.lit, path)).cast("array<int>")
            rows.append(F.struct(
                effect_key(F.col("execution_id"), at, F.lit(ordinal)).alias("effect_key"), F.lit(".".join(map(str, path))).alias("path"), _long(ordinal).alias("ordinal"),
                F.lit(s.cls).alias("class"), F.lit(s.name).alias("op_name"), _long(s.addend).alias("args"), F.lit("performed" if done else "deferred").alias("disposition"),
                (F.lit(None).cast("long") if result is None else _long(result)).alias("result"), (F.lit(False) if done else self._won(path)).alias("released"),
            ))
        if not rows:
            raise PlanError("the plan has no effects")
        return self.df.select("execution_id", F.explode(F.array(*rows)).alias("e")).select("execution_id", "e.*")

    def records(self) -> DataFrame:
        """The run's ledger: execution_id, sequence, path, kind (opened, step, effect, fork, selected, committed), key, scale,
        addend, arms, arm, policy, changes. A commit is one record with all that it changes, so no prefix has half of it."""
        rows = []
        for sequence, (path, kind, of) in enumerate(self._log):
            number = lambda c: (F.lit(None) if of.get(c) is None else _long(of[c])).cast("long").alias(c)  # noqa: B023, E731
            rows.append(F.struct(
                F.lit(sequence).cast("long").alias("sequence"), F.array(*map(F.lit, path)).cast("array<int>").alias("path"), F.lit(kind).alias("kind"), F.lit(of.get("key")).cast("string").alias("key"),
                *map(number, ("scale", "addend", "arms", "arm")), F.lit(of.get("policy")).cast("string").alias("policy"),
                (of["changes"] if "changes" in of else F.lit(None)).cast("array<struct<key:string,value:bigint>>").alias("changes"),
            ))
        return self.df.select("execution_id", F.explode(F.array(*rows)).alias("r")).select("execution_id", "r.*")

    def metrics(self) -> DataFrame:
        """execution_id and the counters that a run determines: what a plan's structure gives is the same for all executions, and what
        selections, commits and releases depend on is counted for each."""
        flag = lambda c: c.cast("long")
        total = lambda cs: sum(cs, F.lit(0).cast("long"))
        kinds = [k for _, k, _ in self._log]
        deferred = [(path, s) for path, _, s, done, _ in self._effects if not done]
        chosen = [(p, of) for p, _, _, of in self._futures[1:] if of]
        counts = {
            "steps_executed": sum(k in ("step", "effect") for k in kinds), "effects_performed": sum(done for *_, done, _ in self._effects), "effects_deferred": len(deferred),
            "effects_released": total(flag(self._won(path)) for path, s in deferred if is_write_class(s.cls)), "futures_forked": len(self._futures) - 1,
            "futures_rejected": total(flag(F.col(of[0]) != p[-1]) for p, of in chosen), "futures_failed": sum(a.fails() for _, a, _, _ in self._futures[1:]),
            "commits": kinds.count("committed"), "commits_with_conflicts": total(flag(F.col(c)) for c in self._conflicts), "records": len(kinds),
        }
        return self.df.select("execution_id", *((F.lit(x) if isinstance(x, int) else x).cast("long").alias(n) for n, x in counts.items()))

    def conflicted(self) -> DataFrame:
        """execution_id, conflicted: whether any commit met a conflict."""
        flags = [F.col(c) for c in self._conflicts]
        return self.df.select("execution_id", (F.greatest(*flags) if len(flags) > 1 else flags[0] if flags else F.lit(False)).alias("conflicted"))
