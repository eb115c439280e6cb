"""Scaling, one-hot slots and the per-slot (masked) form of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixspark.functions.expr import constants
from mixspark.functions.rand import uniform_int
from mixspark.operators.profile import Profile


def scaled(nums: Column, p: Profile) -> Column:
    """Min-max scaled numerics."""
    lo = constants(list(p.num_min))
    span = constants(list(p.spans))
    if p.d <= 32:
        return F.array(*[(nums[j] - lo[j]) / span[j] for j in range(p.d)]).cast("array<double>")
    return F.zip_with(F.zip_with(nums, lo, lambda x, a: x - a), span, lambda x, s: x / s)


def slot_array(cats: Column, p: Profile, handle_unseen: str = "error") -> Column:
    """One-hot position of each categorical; of an indicator its own position if it is 1. A value outside the profile is an error, or with
    ``handle_unseen="zero"`` a null: none of that variable's slots is set."""
    if handle_unseen not in ("error", "zero"):
        raise ValueError("handle_unseen must be 'error' or 'zero'")
    out = []
    for v, (start, width) in enumerate(zip(p.offsets, p.widths)):
        if p.indicator:
            out.append(F.when(cats[v] == 1, F.lit(v)))
            continue
        seen = cats[v].between(0, width - 1)
        bad = F.lit(None).cast("int")
        if handle_unseen == "error":
            bad = F.raise_error(
                F.concat(F.lit(f"categorical {v} has a value outside 0..{width - 1}: "),
                         F.coalesce(cats[v].cast("string"), F.lit("null")))
            ).cast("int")
        out.append(F.when(seen, cats[v] + F.lit(start)).otherwise(bad))
    return F.array(*out).cast("array<int>") if out else F.array().cast("array<int>")


def encode(view: DataFrame, p: Profile, scale: bool = True,
           handle_unseen: str = "error") -> DataFrame:
    """Scale the numerics and add ``slots``. Columns other than cats and nums pass through."""
    nums = scaled(F.col("nums"), p) if scale else F.col("nums")
    return view.withColumns({
        "nums": nums, "slots": slot_array(F.col("cats"), p, handle_unseen),
    })


def indicator_slots(cats: Column) -> Column:
    """Slots of categoricals that are 0/1 indicators already: positions that hold 1."""
    at = F.transform(cats, lambda x, i: F.when(x == 1, i))
    return F.filter(at, lambda i: i.isNotNull())


def one_hot(slots: Column, n_slots: int) -> Column:
    """Dense 0/1 vector of the set slots."""
    if n_slots == 0:
        return F.array().cast("array<double>")
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_slots - 1)),
        lambda i: F.coalesce(F.array_contains(F.array_compact(slots), i), F.lit(False))
        .cast("double"),
    )


def with_bias(bits: Column) -> Column:
    return F.concat(bits, F.array(F.lit(1.0)))


def set_category(cats: Column, index: int, value) -> Column:
    """Replace one categorical."""
    value = value if isinstance(value, Column) else F.lit(value)
    return F.transform(cats, lambda x, i: F.when(i == index, value).otherwise(x))


def label_sign(bit: Column) -> Column:
    """+1 for a set slot, -1 otherwise."""
    return F.when(bit == 1, F.lit(1)).otherwise(F.lit(-1))


def _bit(slots: Column, slot: Column) -> Column:
    return F.array_contains(F.array_compact(slots), slot).cast("int")


def masked_all(encoded: DataFrame, n_slots: int) -> DataFrame:
    """One row per (row, slot) with the slot's bit and sign."""
    slots = F.sequence(F.lit(0), F.lit(n_slots - 1))
    out = encoded.withColumn("slot", F.explode(slots))
    out = out.withColumn("bit", _bit(F.col("slots"), F.col("slot")))
    return out.withColumn("z", label_sign(F.col("bit")))


def masked_random(encoded: DataFrame, n_slots: int, *salt) -> DataFrame:
    """One uniformly drawn slot per row."""
    out = encoded.withColumn("slot", uniform_int(n_slots, F.col("key"), *salt))
    out = out.withColumn("bit", _bit(F.col("slots"), F.col("slot")))
    return out.withColumn("z", label_sign(F.col("bit")))


def _numbers(a: Column) -> Column:
    text = F.transform(a, lambda x: F.format_string("%.6f", x.cast("double")))
    return F.concat(F.lit("("), F.array_join(text, ", "), F.lit(")"))


def row_text(nums: Column, cats: Column, anomaly: Column) -> Column:
    """Readable form of a row."""
    head = F.when(anomaly == 1, "ANOMALY - ").otherwise("")
    return F.concat(head, F.lit("C:"), _numbers(nums), F.lit("##D:"), _numbers(cats))


def masked_text(nums: Column, slot: Column, n_slots: int, bit: Column) -> Column:
    """Readable form of a masked row; the mask is written out."""
    mask = F.transform(F.sequence(F.lit(0), F.lit(n_slots - 1)), lambda i: (i == slot).cast("int"))
    return F.concat(
        F.lit("C:"), _numbers(nums), F.lit("##M:"), _numbers(mask),
        F.lit("##L:"), F.format_string("%.1f", bit.cast("double")),
    )
