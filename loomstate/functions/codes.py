"""Names and their numbers on the wire: a name's number is its place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
KINDS = ("opened", "step", "effect", "fork", "selected", "committed", "settled", "released")
OPERATIONS = ("set", "add", "compute", "sleep", "emit", "fail")
CLASSES = ("pure", "read", "idempotent_write", "compensatable", "irreversible")
DISPOSITIONS = ("performed", "replayed", "deferred")
STATUSES = ("open", "running", "blocked", "evaluable", "selected", "selection_recorded", "committing", "committed", "rejected", "abandoned", "failed")


def code(name: Column, names: tuple[str, ...]) -> Column:
    """The name's number; null for a name that isn't one of them."""
    found = F.array_position(F.array(*map(F.lit, names)), name)
    return F.when(found > 0, (found - 1).cast("int"))


def name_of(number: Column, names: tuple[str, ...]) -> Column:
    """The number's name; null for a number that has none."""
    return F.when(number.between(0, len(names) - 1), F.element_at(F.array(*map(F.lit, names)), (number + 1).cast("int")))
