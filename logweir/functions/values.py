"""Number and text views of a value, and the comparison rules of conditions.

A value compares as a number when both sides read as numbers (numeric text
included) and as text otherwise.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

NUMERIC_TEXT = r"^[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|infinity))\z"
NAN_TEXT = r"(?i)^nan\z"


def number_text(num: Column) -> Column:
    """A double as its shortest decimal text; six or more integer digits beyond 999999 use an exponent."""
    num = num.cast("double")
    shortest = F.abs(num).cast("string")
    mantissa = F.regexp_replace(F.substring_index(shortest, "E", 1), r"\.0$", "")
    exponent = F.substring_index(shortest, "E", -1).cast("int")
    sign = F.when(num < 0, F.lit("-")).otherwise(F.lit(""))
    whole_digits = F.substring_index(shortest, ".", 1)
    seven = F.regexp_replace(
        F.concat(F.substring(whole_digits, 1, 1), F.lit("."), F.substring(whole_digits, 2, 6), F.substring_index(shortest, ".", -1)),
        r"\.?0+$",
        "",
    )
    small = F.regexp_replace(F.format_string("%.20f", num), r"0+$", "")
    return (
        F.when(num.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(num), F.lit("NaN"))
        .when(F.abs(num) == F.lit(math.inf), F.concat(F.when(num < 0, "-").otherwise("+"), F.lit("Inf")))
        .when((num == F.floor(num)) & (F.abs(num) < 1e6), F.floor(num).cast("bigint").cast("string"))
        .when((F.abs(num) >= 1e-3) & (F.abs(num) < 1e6), num.cast("string"))
        .when((F.abs(num) >= 1e-4) & (F.abs(num) < 1e-3), small)
        .when((F.abs(num) >= 1e6) & (F.abs(num) < 1e7), F.concat(sign, seven, F.lit("e+06")))
        .when(F.abs(num) >= 1e7, F.concat(sign, mantissa, F.lit("e+"), F.lpad(exponent.cast("string"), 2, "0")))
        .otherwise(F.concat(sign, mantissa, F.lit("e-"), F.lpad(F.abs(exponent).cast("string"), 2, "0")))
    )


def variant_is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def variant_text(v: Column) -> Column:
    """Text of a variant: strings as they are, numbers as ``number_text``, containers as JSON."""
    plain = v.cast("string")
    # only a longer number is written differently, so most values skip the type check
    same = plain.rlike(r"^(?:-?\d{1,6}\z|[^\d-]|-[^\d]|-?\z)")
    return (
        F.when(F.is_variant_null(v), F.lit("<nil>"))
        .when(same | variant_is_string(v), plain)
        .otherwise(F.coalesce(number_text(F.try_variant_get(v, "$", "double")), plain))
    )


def literal_text(value) -> str:
    """The text of a value from a rule, as ``number_text`` would write it."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None:
        return "<nil>"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        if not math.isfinite(value):
            return "NaN" if math.isnan(value) else f"{'-' if value < 0 else '+'}Inf"
        if value == math.floor(value) and abs(value) < 1e6:
            return str(int(value))
        mantissa, _, exponent = f"{value!r}".partition("e")
        if not exponent and abs(value) < 1e6:
            return mantissa
        digits = f"{value:.17e}" if not exponent else f"{value!r}"
        mantissa, _, exponent = digits.partition("e")
        return f"{mantissa.rstrip('0').rstrip('.') if '.' in mantissa else mantissa}e{int(exponent):+03d}"
    return str(value)


_NUMBER = re.compile(NUMERIC_TEXT.replace(r"\z", r"\Z") + "|" + NAN_TEXT[4:].replace(r"\z", r"\Z").replace("nan", "(?i:nan)"))


def literal_number(value) -> float | None:
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, (int, float)):
        return float(value)
    if isinstance(value, str) and _NUMBER.match(value):
        return float(value)
    return None


# A number compares with NaN as equal: it is neither below nor above.
_TIE = {"eq": True, "ne": False, "gt": False, "lt": False, "ge": True, "le": True}


@dataclass(frozen=True)
class Value:
    """A field as the conditions see it."""

    present: Column  # the field exists (a JSON null counts)
    text: Column
    plain: Column  # cheaper text, equal to `text` wherever that is not a number
    numeric: str  # "always", "never", or "text": when the plain text reads as a number
    null: Column | None = None  # exists but is null; None: never
    string: Column | None = None  # is a string; None: always
    raw: Column | None = None  # the stored column
    floating: bool = False  # an always-numeric column that may hold NaN

    def compare(self, op: str, expected) -> Column:
        """``op`` in eq ne gt lt ge le; never null while the field is present."""
        if expected is None:
            # nothing sorts below null, and only null equals it
            is_null = self.null if self.null is not None else F.lit(False)
            return {"eq": is_null, "ne": ~is_null, "gt": ~is_null, "lt": F.lit(False), "ge": F.lit(True), "le": is_null}[op]
        wanted = literal_number(expected)
        if wanted is None or self.numeric == "never":
            # no number reads like this literal, so equality can use the cheaper text
            text = self.plain if op in ("eq", "ne") and wanted is None else self.text
            result = _apply(op, text, F.lit(literal_text(expected)))
        elif self.numeric == "always":
            # a whole literal stays whole, so that a comparison with an integer column reaches the scan
            whole = abs(wanted) < 2**53 and wanted == int(wanted)
            result = F.lit(_TIE[op]) if math.isnan(wanted) else _apply(op, self.raw, F.lit(int(wanted) if whole else wanted))
            if self.floating:
                result = (result | F.isnan(self.raw)) if _TIE[op] else (result & ~F.isnan(self.raw))
        else:
            number = F.lit(_TIE[op]) if math.isnan(wanted) else _apply(op, self.plain.try_cast("double"), F.lit(wanted))
            result = (
                F.when(self.plain.rlike(NUMERIC_TEXT), number)
                .when(self.plain.rlike(NAN_TEXT), F.lit(_TIE[op]))
                .otherwise(_apply(op, self.plain, F.lit(literal_text(expected))))
            )
        if self.null is not None:
            result = F.when(self.null, F.lit(op in ("ne", "lt", "le"))).otherwise(result)
        return result


def _apply(op: str, left: Column, right: Column) -> Column:
    return {"eq": left == right, "ne": left != right, "gt": left > right, "lt": left < right, "ge": left >= right, "le": left <= right}[op]


def column_value(col: Column, kind: T.DataType) -> Value:
    if isinstance(kind, T.StringType):
        return Value(col.isNotNull(), col, col, "text", raw=col)
    if isinstance(kind, T.VariantType):
        return variant_value(col)
    never = F.lit(False)
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return Value(col.isNotNull(), number_text(col), col.cast("string"), "always", string=never, raw=col, floating=True)
    if isinstance(kind, T.NumericType):
        return Value(col.isNotNull(), col.cast("string"), col.cast("string"), "always", string=never, raw=col)
    return Value(col.isNotNull(), col.cast("string"), col.cast("string"), "never", string=never, raw=col)


def variant_value(v: Column) -> Value:
    return Value(v.isNotNull(), variant_text(v), v.cast("string"), "text", null=F.is_variant_null(v), string=variant_is_string(v), raw=v)
