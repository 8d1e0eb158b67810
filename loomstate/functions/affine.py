"""State operations as affine maps x -> x * scale + addend, and their composition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Operations that nothing is folded across; an emit counts under a key of its own, the others touch none.
BARRIERS = ("sleep", "emit", "fail")
EMITTED = "__emit__"


def scale_of(kind: str = "kind", scale: str = "scale") -> Column:
    """0 for set, 1 for add and emit, the operation's own for compute; null for operations that touch no key."""
    k = F.col(kind)
    return F.when(k == "set", F.lit(0)).when(k.isin("add", "emit"), F.lit(1)).when(k == "compute", F.col(scale)).cast("long")


def is_barrier(kind: str = "kind") -> Column:
    return F.col(kind).isin(*BARRIERS)


def compose_if_fits(pairs: Column) -> Column:
    """An array of structs with scale and addend, in order, as one map {scale, addend, fits}; fits is false where a coefficient leaves 64 bits and no set comes behind it."""
    zero = F.lit(0).cast("long")

    def step(m: Column, o: Column) -> Column:
        resets = o["scale"] == 0
        scale, addend = F.try_multiply(m["scale"], o["scale"]), F.try_add(F.try_multiply(m["addend"], o["scale"]), o["addend"])
        return F.struct(
            F.when(resets, zero).otherwise(F.coalesce(scale, zero)).alias("scale"), F.when(resets, o["addend"]).otherwise(F.coalesce(addend, zero)).alias("addend"),
            (resets | (m["fits"] & scale.isNotNull() & addend.isNotNull())).alias("fits"),
        )

    return F.aggregate(pairs, F.struct(F.lit(1).cast("long").alias("scale"), zero.alias("addend"), F.lit(True).alias("fits")), step)


def apply_all(pairs: Column, value: Column) -> Column:
    """The value behind all maps, one after the other; overflow is an error at the very operation."""
    return F.aggregate(pairs, value, lambda x, o: x * o["scale"] + o["addend"])


def apply_wide(m: Column, value: Column) -> Column:
    """The value behind one map. The product may leave 64 bits, as long as the sum doesn't."""
    wide = "decimal(38,0)"
    return (value.cast(wide) * m["scale"].cast(wide) + m["addend"].cast(wide)).cast("long")
