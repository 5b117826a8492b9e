"""Affine quantization as column expressions: bounds, parameters, quantize, dequantize."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYMMETRIC, ASYMMETRIC = "symmetric", "asymmetric"


def bounds(bits: int, mode: str = SYMMETRIC) -> tuple[int, int]:
    """Least and largest code of 1 to 32 bits. One symmetric bit has the codes -1, 0 and 1."""
    if not 1 <= bits <= 32:
        raise ValueError(f"bits must be 1 to 32, not {bits}")
    if mode == ASYMMETRIC:
        return 0, (1 << bits) - 1
    if mode != SYMMETRIC:
        raise ValueError(f"no such mode: {mode}")
    top = max(1, (1 << (bits - 1)) - 1)
    return -top, top


def storage(bits: int, mode: str = SYMMETRIC) -> str:
    """The narrowest integer type that holds a code."""
    lo, hi = bounds(bits, mode)
    width = next(w for w in (8, 16, 32) if hi < 1 << (w if mode == ASYMMETRIC else w - 1) and lo >= -(1 << (w - 1)))
    return f"{'u' if mode == ASYMMETRIC else ''}int{width}"


def usable(scale: Column) -> Column:
    """1 for a scale that is zero or not finite."""
    return F.when(scale.isNull() | F.isnan(scale) | (F.abs(scale) == float("inf")) | (scale == 0), F.lit(1.0)).otherwise(scale)


def params(lo: Column, hi: Column, bits: int, mode: str = SYMMETRIC) -> Column:
    """struct(scale, zero) for values from lo to hi."""
    lo, hi = lo.cast("double"), hi.cast("double")
    qmin, qmax = bounds(bits, mode)
    if mode == SYMMETRIC:
        return F.struct(usable(F.greatest(F.abs(lo), F.abs(hi)) / F.lit(float(qmax))).alias("scale"), F.lit(0.0).alias("zero"))
    wide = usable((hi - lo) / F.lit(float(qmax - qmin)))
    one = F.when(lo == 0, F.lit(1.0)).otherwise(usable(F.abs(lo) / F.lit(float(qmax))))
    scale = F.when(lo == hi, one).otherwise(wide)
    zero = F.when(lo == hi, F.when(lo < 0, F.lit(float(qmax))).otherwise(0.0)).otherwise(clip(F.rint(-lo / wide), qmin, qmax))
    return F.struct(scale.alias("scale"), zero.alias("zero"))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def quantize(x: Column, scale: Column, zero: Column, bits: int, mode: str = SYMMETRIC) -> Column:
    """The code of a value: halves round to even. A value that is not finite raises, as no code stands for it."""
    x = x.cast("double")
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    code = clip(F.rint(x / scale) + zero, *bounds(bits, mode)).cast("int" if bits < 32 else "long")
    return F.when(bad, F.raise_error(F.lit("a value to quantize is not finite")).cast("int" if bits < 32 else "long")).otherwise(code)


def dequantize(code: Column, scale: Column, zero: Column) -> Column:
    return (code.cast("double") - zero) * scale
