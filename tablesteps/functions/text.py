"""Text forms that must read like the reference's (.NET) output."""

from __future__ import annotations

import math
from decimal import Decimal


def net_number(x) -> str:
    """Format a number the way .NET's default ``ToString()`` does.

    Shortest round-trip digits, no trailing ``.0`` for whole values,
    ``E+XX`` exponent form from 1e15 upward.
    """
    if isinstance(x, bool):
        return "True" if x else "False"
    if isinstance(x, int):
        return str(x)
    if isinstance(x, Decimal):
        return format(x, "f")
    f = float(x)
    if math.isnan(f):
        return "NaN"
    if math.isinf(f):
        return "∞" if f > 0 else "-∞"
    if f.is_integer() and abs(f) < 1e15:
        return str(int(f))
    r = repr(f)
    if "e" in r:
        mant, exp = r.split("e")
        sign = "-" if exp.startswith("-") else "+"
        digits = exp.lstrip("+-").rjust(2, "0")
        mant = mant[:-2] if mant.endswith(".0") else mant
        return f"{mant}E{sign}{digits}"
    if abs(f) >= 1e15:
        mant = f"{f:.16e}".split("e")[0].rstrip("0").rstrip(".")
        return f"{mant}E+{int(math.floor(math.log10(abs(f)))):02d}"
    return r


def net_value(x) -> str:
    """``string.Join`` text of one value (str as is, bool as True/False)."""
    if isinstance(x, str):
        return x
    if x is None:
        return ""
    return net_number(x)
