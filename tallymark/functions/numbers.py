"""Money and number expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from .text import bind, strip_cell

# --- fixed value: what looks like a number once the symbol is ignored --------
NUMERIC_GATE = (r"(?iU)^\s*[-+(]?\s*(?:ZAR|US\$|R|\$|€|£|¥)?\s*"
                r"[0-9][0-9\s\u00a0.,]*\)?\s*%?\s*$")


def cents(c: Column) -> Column:
    """Two decimals, half to even on x*100 (``round`` rounds half up)."""
    return F.rint(c * 100) / 100


def looks_numeric(c: Column) -> Column:
    return F.coalesce(c.rlike(NUMERIC_GATE), F.lit(False))


def parse_amount(c: Column, dtype: T.DataType = T.StringType(), is_tidy: bool = False) -> Column:
    """Currency text to double; numeric input passes through."""
    if isinstance(dtype, T.NumericType):
        value = c.cast("double")
        return F.when(~F.isnan(value), value)
    plain = c.cast("string") if is_tidy else strip_cell(c.cast("string"))

    def from_text(t):
        t = F.regexp_replace(t, r"^[()]+|[()]+$", "")
        t = F.regexp_replace(t, r"(?iU)\b(?:zar|rand)\b", "")
        return F.regexp_replace(t, r"[Rr \u00a0]", "")

    def number(t):
        # commas are decimal only without a dot and before one or two last digits
        t = (F.when(t.rlike(r"^[^.]*,\d{1,2}$"), F.translate(t, ",", "."))
             .otherwise(F.translate(t, ",", "")))
        return F.regexp_replace(t, r"[^0-9.\-]", "").try_cast("double")

    def signed(t):
        sign = F.when(t.startswith("(") & t.endswith(")"), -1.0).otherwise(1.0)
        return bind(from_text(t), number) * sign

    return (F.when(plain.rlike(r"^-?[0-9]+(?:\.[0-9]+)?$"), plain.try_cast("double"))
            .otherwise(bind(plain, signed)))


def money_text(c: Column, symbol: str = "R", decimals: int = 0) -> Column:
    """Thousands separators and a symbol, for report cells only."""
    prefix = f"{symbol} " if symbol else ""
    return F.concat(F.lit(prefix), F.format_number(F.coalesce(c, F.lit(0.0)), decimals))


def share(part: Column, whole: Column) -> Column:
    """Percent of ``whole`` to one decimal."""
    return F.rint(part * 1000.0 / F.greatest(whole, F.lit(1))) / 10
