"""Row-wise operators. NULL in, NULL out unless said otherwise; domain errors give NULL, never NaN or an error."""

from __future__ import annotations

import datetime as dt
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.columns import safe_div
from ..plans.spec import Choice, Float, Int, RequestError, Scalar, Scalars, operator

DTYPES = ("bool", "int", "long", "float", "double", "string", "symbol", "date", "timestamp")
SPARK_TYPE = {"bool": "boolean", "int": "int", "long": "bigint", "float": "float", "double": "double", "string": "string", "symbol": "string", "date": "date", "timestamp": "timestamp_ntz"}
WHOLE = 2.0**53


def _num(c: Column) -> Column:
    return c.cast("double")


def _both(left: Column, right: Column, value: Column) -> Column:
    return F.when(left.isNotNull() & right.isNotNull(), value)


def _direct(name, fields="left right", output="NUMBER", **more):
    return operator("DIRECT", name, fields, output, **more)


def _floored(q: Column) -> Column:
    return F.when(F.abs(q) >= WHOLE, q).otherwise(F.floor(q).cast("double"))


for _name, _f in {"add": lambda a, b: _num(a) + _num(b), "sub": lambda a, b: _num(a) - _num(b), "mul": lambda a, b: _num(a) * _num(b)}.items():
    _direct(f"binary.{_name}")(_f)
for _name, _f in {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "ge": lambda a, b: a >= b, "gt": lambda a, b: a > b, "le": lambda a, b: a <= b, "lt": lambda a, b: a < b}.items():
    _direct(f"binary.{_name}", output="BOOL")(_f)
for _name, _f in {"and": lambda a, b: _both(a, b, a & b), "or": lambda a, b: _both(a, b, a | b), "xor": lambda a, b: a != b}.items():
    _direct(f"binary.{_name}", "left? right?", "BOOL")(_f)
for _name, _f in {"maximum": lambda a, b: _both(a, b, F.greatest(a, b)), "minimum": lambda a, b: _both(a, b, F.least(a, b))}.items():
    _direct(f"binary.{_name}")(_f)


@_direct("binary.days_between")
def days_between(left, right):
    """Calendar days, left minus right."""
    return F.datediff(F.to_date(left), F.to_date(right))


@_direct("binary.div")
def div(left, right):
    return safe_div(_num(left), _num(right))


@_direct("binary.floor_div")
def floor_div(left, right):
    return _floored(safe_div(_num(left), _num(right)))


@_direct("binary.mod")
def mod(left, right):
    """Remainder with the sign of the divisor."""
    return _num(left) - _floored(safe_div(_num(left), _num(right))) * _num(right)


@_direct("binary.null_if", output="ANY")
def null_if(left, right):
    return F.when(F.coalesce(left == right, F.lit(False)), None).otherwise(left)


@_direct("binary.pow")
def power(left, right):
    return F.nanvl(F.pow(_num(left), _num(right)), F.lit(None).cast("double"))


def _multi(name, output="NUMBER", fields="cols+", **more):
    return operator("DIRECT", f"multiary.{name}", fields, output, **more)


def _count(cols):
    return reduce(lambda a, b: a + b, [c.isNotNull().cast("int") for c in cols])


def _some(cols, value):
    return F.when(F.coalesce(*[_num(c) for c in cols]).isNotNull(), value)


def _sum(cols):
    return _some(cols, reduce(lambda a, b: a + b, [F.coalesce(_num(c), F.lit(0.0)) for c in cols]))


_multi("add")(_sum)
_multi("mul")(lambda cols: _some(cols, reduce(lambda a, b: a * b, [F.coalesce(_num(c), F.lit(1.0)) for c in cols])))
_multi("and", "BOOL", "cols?+")(lambda cols: reduce(lambda a, b: _both(a, b, a & b), cols))
_multi("or", "BOOL", "cols?+")(lambda cols: reduce(lambda a, b: _both(a, b, a | b), cols))
_multi("coalesce", "ANY")(lambda cols: F.coalesce(*cols))
_multi("count")(_count)
_multi("max")(lambda cols: F.greatest(*cols) if len(cols) > 1 else cols[0])
_multi("min")(lambda cols: F.least(*cols) if len(cols) > 1 else cols[0])


@_multi("mean")
def row_mean(cols):
    return safe_div(_sum(cols), _count(cols).cast("double"))


@_multi("var", params={"ddof": Choice(0, 1, default=1)})
def row_var(cols, ddof):
    """Variance of the operands that are not NULL, NULL unless there are more than ddof."""
    n, mean = _count(cols), row_mean(cols)
    squares = reduce(lambda a, b: a + b, [F.coalesce((_num(c) - mean) * (_num(c) - mean), F.lit(0.0)) for c in cols])
    return F.when(n > ddof, squares / (n - ddof).cast("double"))


@_multi("std", params={"ddof": Choice(0, 1, default=1)})
def row_std(cols, ddof):
    return F.sqrt(row_var(cols, ddof))


operator("DIRECT", "nullary.true", "", "BOOL")(lambda: F.lit(True))
operator("DIRECT", "nullary.false", "", "BOOL")(lambda: F.lit(False))


def _literal_rule(p):
    value, kind = p["value"], p["dtype"]
    if value is None and kind is None:
        raise RequestError("a NULL literal needs a dtype")
    if value is None or kind is None:
        return
    if kind in ("date", "timestamp"):
        try:
            if not isinstance(value, str):
                raise ValueError
            got = dt.datetime.fromisoformat(value)
            if got.tzinfo or (kind == "date" and not re.fullmatch(r"\d{4}-\d\d-\d\d", value)):
                raise ValueError
        except ValueError:
            raise RequestError(f"{value!r} is no ISO {kind} without a time zone") from None
    elif kind == "bool" and not isinstance(value, bool):
        raise RequestError(f"{value!r} is no truth value")
    elif kind in ("int", "long", "float", "double") and (isinstance(value, (bool, str)) or (kind in ("int", "long") and value != int(value))):
        raise RequestError(f"{value!r} is no {kind}")
    elif kind in ("string", "symbol") and not isinstance(value, str):
        raise RequestError(f"{value!r} is no {kind}")


@operator("DIRECT", "nullary.literal", "", "ANY", rule=_literal_rule, kind_of=lambda p: "BOOL" if p["dtype"] == "bool" or isinstance(p["value"], bool) else "ANY", params={"value": Scalar(), "dtype": Choice(*DTYPES, default=None)})
def literal(value, dtype):
    if dtype is None:
        return F.lit(value)
    if dtype == "timestamp" and value is not None:
        return F.lit(dt.datetime.fromisoformat(value).isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value).cast(SPARK_TYPE[dtype])


@operator("DIRECT", "ternary.where", "condition? if_true if_false", "ANY")
def where(condition, if_true, if_false):
    """NULL where the condition is."""
    return F.when(condition, if_true).when(~condition, if_false)


def _unary(name, output="NUMBER", **more):
    return operator("DIRECT", f"unary.{name}", "col?" if name == "not" else "col", output, **more)


def _inside(x, f):
    return F.when(F.abs(_num(x)) <= 1, f(_num(x)))


_CALENDAR = {
    "day": F.dayofmonth,
    "day_of_year": F.dayofyear,
    "month": F.month,
    "quarter": F.quarter,
    "week": F.weekofyear,
    "weekday": F.weekday,
    "year": F.year,
}
for _name, _g in _CALENDAR.items():
    _unary(_name)(lambda col, g=_g: g(col))
_NUMBERS = {
    "abs": lambda x: F.abs(_num(x)),
    "acos": lambda x: _inside(x, F.acos),
    "asin": lambda x: _inside(x, F.asin),
    "atan": lambda x: F.atan(_num(x)),
    "ceil": lambda x: F.when(F.abs(_num(x)) >= WHOLE, _num(x)).otherwise(F.ceil(_num(x)).cast("double")),
    "cos": lambda x: F.cos(_num(x)),
    "exp": lambda x: F.exp(_num(x)),
    "expm1": lambda x: F.expm1(_num(x)),
    "floor": lambda x: _floored(_num(x)),
    "log": lambda x: F.log(_num(x)),
    "log10": lambda x: F.log10(_num(x)),
    "log1p": lambda x: F.log1p(_num(x)),
    "log2": lambda x: F.log2(_num(x)),
    "neg": lambda x: -_num(x),
    "sign": lambda x: F.signum(_num(x)).cast("int"),
    "sin": lambda x: F.sin(_num(x)),
    "sqrt": lambda x: F.when(_num(x) >= 0, F.sqrt(_num(x))),
    "tan": lambda x: F.tan(_num(x)),
}
for _name, _g in _NUMBERS.items():
    _unary(_name)(lambda col, g=_g: g(col))
_unary("get", "ANY")(lambda col: col)
_TESTS = {
    "is_finite": lambda x: F.coalesce(_num(x).isNotNull() & ~F.isnan(_num(x)) & (F.abs(_num(x)) != float("inf")), F.lit(False)),
    "is_month_end": lambda x: F.last_day(x) == F.to_date(x),
    "is_null": lambda x: x.isNull(),
    "is_quarter_end": lambda x: (F.last_day(x) == F.to_date(x)) & (F.month(x) % 3 == 0),
    "is_weekend": lambda x: F.weekday(x) >= 5,
    "is_year_end": lambda x: (F.month(x) == 12) & (F.dayofmonth(x) == 31),
    "not": lambda x: ~x,
    "not_null": lambda x: x.isNotNull(),
}
for _name, _g in _TESTS.items():
    _unary(_name, "BOOL")(lambda col, g=_g: g(col))


def _ordered(p):
    if p["lower"] is not None and p["upper"] is not None and p["lower"] > p["upper"]:
        raise RequestError("lower may not exceed upper")


@_unary("between", "BOOL", rule=_ordered, params={"lower": Float(), "upper": Float(), "inclusive": Choice("both", "left", "right", "neither", default="both")})
def between(col, lower, upper, inclusive):
    """NULL is not between."""
    low = col >= lower if inclusive in ("both", "left") else col > lower
    high = col <= upper if inclusive in ("both", "right") else col < upper
    return F.coalesce(low & high, F.lit(False))


@_unary("cast", "ANY", kind_of=lambda p: "BOOL" if p["dtype"] == "bool" else "ANY", params={"dtype": Choice(*DTYPES)})
def cast(col, dtype):
    """Fractions round half away from zero on the way to whole numbers; what can't be cast is NULL."""
    kind = SPARK_TYPE[dtype]
    if dtype in ("int", "long"):
        return F.coalesce(F.round(col.try_cast("double")).try_cast(kind), col.try_cast(kind))
    return col.try_cast(kind)


def _clip_rule(p):
    if p["lower"] is None and p["upper"] is None:
        raise RequestError("clip needs lower or upper")
    _ordered(p)


@_unary("clip", rule=_clip_rule, params={"lower": Float(None), "upper": Float(None)})
def clip(col, lower, upper):
    out = _num(col)
    if lower is not None:
        out = F.when(out < lower, lower).otherwise(out)
    if upper is not None:
        out = F.when(out > upper, upper).otherwise(out)
    return out


@_unary("isin", "BOOL", params={"values": Scalars()})
def isin(col, values):
    """NULL is in the list if the list holds NULL; the answer is never NULL."""
    known = [v for v in values if v is not None]
    found = F.coalesce(col.isin(*known), F.lit(False)) if known else F.lit(False)
    return found | col.isNull() if None in values else found


def _paired(p):
    if len(p["old"]) != len(p["new"]):
        raise RequestError("old and new differ in length")


@_unary("replace", "ANY", rule=_paired, params={"old": Scalars(), "new": Scalars()})
def replace(col, old, new):
    """One pair after another: later ones see what earlier ones made."""
    for a, b in zip(old, new):
        col = F.when(col.eqNullSafe(F.lit(a)), F.lit(b)).otherwise(col)
    return col


@_unary("round", params={"precision": Int(0, ge=0, le=15)})
def round_(col, precision):
    """Half away from zero."""
    return F.round(_num(col), precision)


