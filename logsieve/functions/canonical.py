"""Canonical JSON of any column: keys sorted, ``", "`` and ``": "`` between parts, nulls kept, ASCII only.

The texts are those of Python's ``json.dumps(..., sort_keys=True, default=str)``: doubles have the fewest digits that read
back as the same double (beyond 2^53 and below 1e-307 the last digit may be another one that does too), timestamps are
``YYYY-MM-DD HH:MM:SS[.ffffff]+00:00``. A null map is an empty object. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters with a short escape, by their UTF-16 units.
_SHORT = {"0022": '\\"', "005c": "\\\\", "0008": "\\b", "0009": "\\t", "000a": "\\n", "000c": "\\f", "000d": "\\r"}


def json_text(c: Column) -> Column:
    """A string in quotes, everything but printable ASCII escaped by UTF-16 units."""
    units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
    each = F.transform(F.sequence(F.lit(0), (F.length(units) / 4).cast("int") - 1), lambda i: F.substring(units, 4 * i + 1, F.lit(4)))

    def escaped(unit: Column) -> Column:
        plain = F.char(F.conv(unit, 16, 10).cast("bigint"))
        out = F.when(unit.between("0020", "007e"), plain).otherwise(F.concat(F.lit("\\u"), unit))
        for code, short in _SHORT.items():
            out = F.when(unit == code, short).otherwise(out)
        return out

    simple = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    inner = F.when(c.rlike("^[ -~]*$"), simple).otherwise(F.array_join(F.transform(each, escaped), ""))
    return F.concat(F.lit('"'), inner, F.lit('"'))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def json_double(c: Column) -> Column:
    """The shortest decimal text of a double, positional from 1e-4 up to 1e16."""

    def shortest(x: Column) -> Column:
        text = F.lower(x.cast("string"))
        for n in (17, 16, 15):  # more than 17 digits are never needed, fewer are tried first
            text = F.when(F.format_string(f"%.{n - 1}e", x).try_cast("double") == x, F.format_string(f"%.{n - 1}e", x)).otherwise(text)
        return text

    def parts(text: Column) -> Column:
        mantissa = F.replace(F.split_part(text, F.lit("e"), F.lit(1)), F.lit("."), F.lit(""))
        return F.struct(F.regexp_replace(mantissa, "0+$", "").alias("figures"), F.split_part(text, F.lit("e"), F.lit(2)).try_cast("int").alias("power"))

    def shown(p: Column) -> Column:
        figures, power, n = p["figures"], p["power"], F.length(p["figures"])
        whole = F.concat(F.substring(figures, F.lit(1), power + 1), F.lit("."), F.substring(figures, power + 2, n))
        above = F.when(n > power + 1, whole).otherwise(F.concat(F.rpad(figures, power + 1, F.lit("0")), F.lit(".0")))
        below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), figures)
        rest = F.when(n > 1, F.concat(F.lit("."), F.substring(figures, F.lit(2), n))).otherwise("")
        exponent = F.concat(F.when(power < 0, "-").otherwise("+"), F.when(F.abs(power) < 10, "0").otherwise(""), F.abs(power).cast("string"))
        far = F.concat(F.substring(figures, F.lit(1), F.lit(1)), rest, F.lit("e"), exponent)
        return F.when(power.between(0, 15), above).when(power.between(-4, -1), below).otherwise(far)

    def signed(v: Column) -> Column:
        sign, x = F.when((v < 0) | (v.cast("string") == "-0.0"), "-").otherwise(""), F.abs(v)
        digits = _let(_let(_let(x, shortest), parts), shown)
        bounded = F.when(x == float("inf"), "Infinity").when(x == 0.0, "0.0").otherwise(digits)
        return F.when(F.isnan(v), "NaN").otherwise(F.concat(sign, bounded))

    return _let(c, signed)


def time_text(c: Column) -> Column:
    whole, fraction = F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.date_format(c, "SSSSSS")
    return F.concat(whole, F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("+00:00"))


def _joined(parts: Column, opens: str, closes: str) -> Column:
    return F.concat(F.lit(opens), F.array_join(parts, ", "), F.lit(closes))


def canonical_json(c: Column, kind: T.DataType) -> Column:
    """JSON text of a column of type ``kind``."""
    null = F.lit("null")
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(json_text(F.lit(f.name)), F.lit(": "), canonical_json(c[f.name], f.dataType)) for f in fields]
        return F.when(c.isNull(), null).otherwise(_joined(F.array(*parts), "{", "}"))
    if isinstance(kind, T.ArrayType):
        return F.when(c.isNull(), null).otherwise(_joined(F.transform(c, lambda x: canonical_json(x, kind.elementType)), "[", "]"))
    if isinstance(kind, T.MapType):
        pair = lambda e: F.concat(json_text(e["key"]), F.lit(": "), canonical_json(e["value"], kind.valueType))
        return F.coalesce(_joined(F.transform(F.array_sort(F.map_entries(c)), pair), "{", "}"), F.lit("{}"))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce(json_double(c.cast("double")), null)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.coalesce(json_text(time_text(c)), null)
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return F.coalesce(c.cast("string"), null)
    return F.coalesce(_let(c.cast("string"), json_text), null)
