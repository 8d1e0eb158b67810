"""Building a plan. A plan is metadata: a short list of steps on the driver; the executions that run it are the data.

Values may be numbers, or columns of the executions that the plan runs over, so that one plan serves all of them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column

from ..operators.effects import CLASSES, IRREVERSIBLE, READ, is_write_class, speculatable_class

EVALUATORS = ("highest_score", "lowest_score", "cheapest", "first_by_identity", "only_without_irreversible")
Value = int | Column


class PlanError(ValueError):
    """A plan that can't be run, whatever the executions hold."""


@dataclass(frozen=True)
class Step:
    kind: str
    key: str | None = None
    scale: Value = 1
    addend: Value = 0
    cost_ms: int = 1
    name: str = ""
    #: effects: class, and the key that a read's result goes to
    cls: str = ""
    reads_into: str | None = None
    #: forks: the arms; selections: the evaluator in name and its key; commits: what a conflict does in name
    arms: tuple["Plan", ...] = ()


@dataclass
class Plan:
    steps: list[Step] = field(default_factory=list)

    def _with(self, **of) -> "Plan":
        self.steps.append(Step(**of))
        return self

    def set(self, key: str, value: Value, cost_ms: int = 1) -> "Plan":
        return self._with(kind="set", key=key, scale=0, addend=value, cost_ms=cost_ms)

    def add(self, key: str, by: Value, cost_ms: int = 1) -> "Plan":
        return self._with(kind="add", key=key, addend=by, cost_ms=cost_ms)

    def compute(self, key: str, scale: Value, addend: Value, cost_ms: int = 1) -> "Plan":
        return self._with(kind="compute", key=key, scale=scale, addend=addend, cost_ms=cost_ms)

    def sleep(self, ms: int) -> "Plan":
        return self._with(kind="sleep", addend=ms, cost_ms=ms)

    def emit(self, name: str) -> "Plan":
        """Counts under the key __emit__."""
        return self._with(kind="emit", key="__emit__", addend=1, name=name)

    def fail(self, why: str = "") -> "Plan":
        """Ends an arm as failed; on the trunk the plan is refused."""
        return self._with(kind="fail", name=why)

    def effect(self, cls: str, name: str, args: Value, reads_into: str | None = None, cost_ms: int = 1) -> "Plan":
        if cls not in CLASSES:
            raise PlanError(f"no such class of effects: {cls}")
        if reads_into is not None and cls != READ:
            raise PlanError("only a read has a result to keep")
        return self._with(kind="effect", cls=cls, name=name, addend=args, reads_into=reads_into, cost_ms=cost_ms)

    def fork(self, *arms: "Plan") -> "Plan":
        if len(arms) < 2:
            raise PlanError("a fork has two arms at least")
        return self._with(kind="fork", arms=tuple(arms))

    def select(self, evaluator: str, key: str = "score") -> "Plan":
        if evaluator not in EVALUATORS:
            raise PlanError(f"no such evaluator: {evaluator}")
        return self._with(kind="select", name=evaluator, key=key)

    def commit(self, on_conflict: str = "abort") -> "Plan":
        if on_conflict not in ("abort", "take_future"):
            raise PlanError(f"no such policy: {on_conflict}")
        return self._with(kind="commit", name=on_conflict)

    # What can be told without any data

    def keys(self) -> list[str]:
        """Every key that the plan writes or scores, in order."""
        own = {k for s in self.steps for k in (s.key, s.reads_into) if k}
        return sorted(own.union(*(a.keys() for s in self.steps for a in s.arms)))

    def nodes(self, path: tuple[int, ...] = ()) -> list[tuple]:
        """(node_id, path, kind, next_node): depth first, arms right behind their fork; -1 where a path ends."""
        found: list[tuple] = []
        self._number(path, found)
        return found

    def _number(self, path: tuple[int, ...], found: list[tuple]) -> None:
        at, first = None, 0
        for s in self.steps:
            if at is not None:
                found[at] = (*found[at][:3], len(found))
            at = len(found)
            found.append((at, path, s.kind, -1))
            for i, arm in enumerate(s.arms, first):
                arm._number((*path, i), found)
            first += len(s.arms)

    def widest_fork(self) -> int:
        return max((max(len(s.arms), *(a.widest_fork() for a in s.arms)) for s in self.steps if s.arms), default=0)

    def fails(self) -> bool:
        return any(s.kind == "fail" for s in self.steps)

    def until_failure(self) -> list[Step]:
        """The steps that run: a failure ends them."""
        return self.steps[: next((i for i, s in enumerate(self.steps) if s.kind == "fail"), len(self.steps))]

    def cost_ms(self) -> int:
        return sum(s.cost_ms for s in self.until_failure() if s.kind not in ("fork", "select", "commit"))

    def irreversible_deferred(self, authoritative: bool) -> int:
        return 0 if authoritative else sum(s.cls == IRREVERSIBLE for s in self.until_failure())

    def deferred(self, authoritative: bool) -> list[Step]:
        return [s for s in self.until_failure() if s.kind == "effect" and not (authoritative or speculatable_class(s.cls)) and is_write_class(s.cls)]
