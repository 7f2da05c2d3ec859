"""Scalar column expressions. All stay inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def conc_key(conc: Column | str) -> Column:
    """Dose label with one decimal (half up; a label, never a join key)."""
    return F.round(conc, 1)


def within(conc: Column, target: float, eps: float = 0.001) -> Column:
    """``abs(conc - target) < eps`` as two bounds, which parquet can prune on."""
    return (conc > F.lit(target - eps)) & (conc < F.lit(target + eps))


def pct_change(log2fc: Column | str) -> Column:
    return (F.pow(F.lit(2.0), log2fc) - 1) * 100


def normalise_name(name: Column | str) -> Column:
    return F.translate(F.upper(name), "- ", "")


def safe_name(name: Column | str) -> Column:
    """Name usable in a file name."""
    return F.translate(name, "/ ", "__")


def treatment_label(drug: Column | str, conc: Column | str, cell_line: Column | str) -> Column:
    dose = F.concat(F.col(conc).cast("string") if isinstance(conc, str) else conc.cast("string"), F.lit("uM"))
    return F.concat_ws("_", drug, dose, cell_line)


def result_key(drug: Column | str, conc: Column | str) -> Column:
    return F.concat_ws("_", safe_name(drug), conc_key(conc).cast("string"))


def ic50_um(ln_ic50: Column | str) -> Column:
    return F.round(F.exp(ln_ic50), 4)


def matches(col: Column, pattern: str, literal: bool = False) -> Column:
    """Case-insensitive partial match; a null value does not match."""
    hit = F.contains(F.lower(col), F.lit(pattern.lower())) if literal else col.rlike("(?i)" + pattern)
    return F.coalesce(hit, F.lit(False))


def fixed(value: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded from the exact binary value as C and Python do.

    ``value * 10**digits`` is split into a rounded product and its exact error,
    which decides what looks like a tie; a true tie goes to the even digit.
    """
    scale = F.lit(10.0**digits)
    size = F.abs(value)
    lifted = size * F.lit(134217729.0)
    high = lifted - (lifted - size)
    low = size - high
    product = size * scale
    error = (high * scale - product) + low * scale
    whole = F.floor(product).cast("double")
    rest = product - whole
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    return F.format_string(f"%.{digits}f", F.signum(value) * (whole + up.cast("double")) / scale)


def is_ensembl(gene: Column | str) -> Column:
    return F.coalesce(F.startswith(F.col(gene) if isinstance(gene, str) else gene, F.lit("ENSG")), F.lit(False))


def rank_metric(log2fc: Column, padj: Column, floor: float = 1e-300) -> Column:
    """``sign(log2fc) * -log10(padj)``; adding 0.0 clears a negative zero."""
    return F.signum(log2fc) * -F.log10(F.greatest(padj, F.lit(floor))) + F.lit(0.0)


def grams(name: Column, sizes: Sequence[int]) -> Column:
    """Distinct stretches of a lower-cased name of the given lengths: at most one per character and length."""
    low = F.lower(name)

    def of_length(k: int) -> Column:
        starts = F.when(F.length(low) >= k, F.sequence(F.lit(1), F.length(low) - k + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.substring(low, at, F.lit(k)))

    return F.array_distinct(F.concat(*[of_length(k) for k in sizes]))


# Fixed values of the permutation key: a prime modulus and two multipliers, all
# below 2**31 so that every product fits a signed 64-bit integer.
MIX_PRIME = 2147483647
MIX_STEP = 1000003
MIX_A = 739982445
MIX_B = 695872825


def gene_code(gene: Column | str) -> Column:
    """32-bit code of a gene name, the same in every treatment."""
    return F.conv(F.substring(F.md5(gene), 1, 8), 16, 10).cast("bigint")


def permutation_key(code: Column, permutation: Column) -> Column:
    """Sort key that shuffles genes: ordering by it gives permutation number ``permutation``."""
    prime = F.lit(MIX_PRIME).cast("bigint")

    def fold(x: Column, bits: int) -> Column:
        return x.bitwiseXOR(F.shiftright(x, bits))

    x = (code + permutation.cast("bigint") * F.lit(MIX_STEP).cast("bigint")) % prime
    x = fold(x, 15) * F.lit(MIX_A).cast("bigint") % prime
    x = fold(x, 12) * F.lit(MIX_B).cast("bigint") % prime
    return fold(x, 15)
