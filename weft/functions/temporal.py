"""Dates, instants with optional offsets, and durations."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from weft.errors import GraphError
from weft.functions.values import DATE, DATETIME, DURATION, INT, Value, bad, guard

SECOND, DAY = 10**9, 86_400 * 10**9
_DATE = re.compile(r"(-?\d{4})-(\d\d)-(\d\d)\Z")
_DATETIME = re.compile(r"(-?\d{4})-(\d\d)-(\d\d)[Tt](\d\d):(\d\d):(\d\d)(?:\.(\d{1,9}))?(?:([Zz])|([+-])(\d\d):(\d\d))?\Z")
_DURATION = re.compile(r"([+-]?)P(?:(\d+)W|(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:(T)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d{1,9}))?S)?)?)\Z")
_EPOCH = dt.date(1970, 1, 1)


def parse_date(text: str) -> int:
    """Days since 1970-01-01."""
    m = _DATE.match(text)
    try:
        if m and int(m[1]) >= 1:
            return (dt.date(int(m[1]), int(m[2]), int(m[3])) - _EPOCH).days
    except ValueError:
        pass
    raise GraphError("InvalidArgument", f"{text!r} is not a date")


def parse_datetime(text: str) -> tuple[int, int | None]:
    m = _DATETIME.match(text)
    if m:
        days = parse_date(f"{m[1]}-{m[2]}-{m[3]}")
        h, mi, s, frac = int(m[4]), int(m[5]), int(m[6]), int((m[7] or "0").ljust(9, "0"))
        off = None if not (m[8] or m[9]) else 0 if m[8] else (1 if m[9] == "+" else -1) * (int(m[10]) * 3600 + int(m[11]) * 60)
        if h < 24 and mi < 60 and s < 60 and abs(off or 0) <= 18 * 3600 and not (m[9] and int(m[11]) > 59):
            nanos = days * DAY + (h * 3600 + mi * 60 + s - (off or 0)) * SECOND + frac
            if -(1 << 63) <= nanos < 1 << 63:
                return nanos, off
    raise GraphError("InvalidArgument", f"{text!r} is not a date and time")


def parse_duration(text: str) -> tuple[int, int, int]:
    m = _DURATION.match(text)
    if not m or not any(m[i] for i in (2, 3, 4, 5, 7, 8, 9)) or (m[6] and not any(m[i] for i in (7, 8, 9))):
        raise GraphError("InvalidArgument", f"{text!r} is not a duration")
    sign = -1 if m[1] == "-" else 1
    n = lambda i: int(m[i] or 0)
    out = (sign * (n(3) * 12 + n(4)), sign * (n(2) * 7 + n(5)), sign * ((n(7) * 3600 + n(8) * 60 + n(9)) * SECOND + int((m[10] or "0").ljust(9, "0"))))
    if any(not -(1 << 63) <= x < 1 << 63 for x in out):
        raise GraphError("InvalidArgument", f"{text!r} is out of range")
    return out


def date_lit(days: int) -> Column:
    return F.date_from_unix_date(F.lit(days))


def datetime_lit(nanos: int, off: int | None) -> Column:
    return F.struct(F.lit(nanos).cast("bigint").alias("nanos"), F.lit(off).cast("int").alias("off"))


def duration_lit(months: int, days: int, nanos: int) -> Column:
    return duration(F.lit(months), F.lit(days), F.lit(nanos))


def duration(months: Column, days: Column, nanos: Column) -> Column:
    return F.struct(months.cast("bigint").alias("months"), days.cast("bigint").alias("days"), nanos.cast("bigint").alias("nanos"))


def _floor_div(a: Column, n: int) -> Column:
    """Rounded down: pmod is never negative."""
    return F.call_function("div", a - F.pmod(a, F.lit(n).cast("bigint")), F.lit(n).cast("bigint"))


def local_nanos(v: Column) -> Column:
    return v["nanos"] + F.coalesce(v["off"], F.lit(0)).cast("bigint") * SECOND


def local_date(v: Column) -> Column:
    return F.date_from_unix_date(_floor_div(local_nanos(v), DAY).cast("int"))


def utc_date(v: Column) -> Column:
    return F.date_from_unix_date(_floor_div(v["nanos"], DAY).cast("int"))


def add_to_date(d: Column, months: Column, days: Column) -> Column:
    return F.date_add(F.add_months(d, months.cast("int")), days.cast("int"))


def add(a: Value, b: Value, sign: int) -> Value | None:
    """a + b or a - b where one of them is temporal; None if neither is."""
    kinds = (a.kind, b.kind)
    if kinds == ("duration", "duration"):
        part = lambda k: a.col[k] + b.col[k] if sign > 0 else a.col[k] - b.col[k]
        return Value(_both(a, b, duration(part("months"), part("days"), part("nanos"))), DURATION)
    if kinds == ("date", "duration"):
        if sign < 0:
            return None
        moved = add_to_date(a.col, b.col["months"], b.col["days"])
        return Value(guard(b.col["nanos"] != 0, "a date takes whole days", moved, DATE), DATE)
    if kinds == ("duration", "date") and sign > 0:
        return add(b, a, sign)
    if kinds == ("datetime", "duration"):
        if sign < 0:
            return None
        local = local_nanos(a.col)
        within = F.pmod(local, F.lit(DAY).cast("bigint"))
        day = F.unix_date(add_to_date(local_date(a.col), b.col["months"], b.col["days"])).cast("bigint")
        nanos = day * DAY + within - F.coalesce(a.col["off"], F.lit(0)).cast("bigint") * SECOND + b.col["nanos"]
        return Value(_both(a, b, F.struct(nanos.alias("nanos"), a.col["off"].alias("off"))), DATETIME)
    if kinds == ("duration", "datetime") and sign > 0:
        return add(b, a, sign)
    if kinds == ("date", "date") and sign < 0:
        return Value(_both(a, b, duration(F.lit(0), F.datediff(a.col, b.col), F.lit(0))), DURATION)
    if kinds == ("datetime", "datetime") and sign < 0:
        return Value(_both(a, b, duration(F.lit(0), F.lit(0), a.col["nanos"] - b.col["nanos"])), DURATION)
    return None


def _both(a: Value, b: Value, col: Column) -> Column:
    return F.when(a.col.isNotNull() & b.col.isNotNull(), col)


def scale(d: Value, n: Value) -> Value:
    return Value(_both(d, n, duration(*[d.col[k] * n.col for k in ("months", "days", "nanos")])), DURATION)


def divide(d: Value, n: Value) -> Value:
    part = lambda k: F.call_function("div", d.col[k], n.col)
    return Value(_both(d, n, duration(*[part(k) for k in ("months", "days", "nanos")])), DURATION)


_CALENDAR = {"year": F.year, "month": F.month, "day": F.dayofmonth, "quarter": F.quarter, "dayofweek": lambda d: F.weekday(d) + 1}
_CLOCK = {"hour": (3600 * SECOND, 24), "minute": (60 * SECOND, 60), "second": (SECOND, 60)}
_FRACTION = {"millisecond": 10**6, "microsecond": 10**3, "nanosecond": 1}
_SPAN = {"hours": 3600 * SECOND, "minutes": 60 * SECOND, "seconds": SECOND}
PARTS = (*_CALENDAR, *_CLOCK, *_FRACTION, "offsetseconds", "months", "days", "nanoseconds", *_SPAN)


def part(name: str, v: Value) -> Value:
    """A part of a date, an instant (in its own offset) or a duration."""
    if name in _CALENDAR and v.kind in ("date", "datetime"):
        return Value(_CALENDAR[name](v.col if v.kind == "date" else local_date(v.col)).cast("bigint"), INT)
    if v.kind == "datetime" and name in _CLOCK:
        unit, mod = _CLOCK[name]
        return Value(F.pmod(_floor_div(local_nanos(v.col), unit), F.lit(mod).cast("bigint")), INT)
    if v.kind == "datetime" and name in _FRACTION:
        return Value(_floor_div(F.pmod(local_nanos(v.col), F.lit(SECOND).cast("bigint")), _FRACTION[name]), INT)
    if v.kind == "datetime" and name == "offsetseconds":
        return Value(v.col["off"].cast("bigint"), INT)
    if v.kind == "duration" and name in ("months", "days", "nanoseconds"):
        return Value(v.col["nanos" if name == "nanoseconds" else name], INT)
    if v.kind == "duration" and name in _SPAN:
        return Value(F.call_function("div", v.col["nanos"], F.lit(_SPAN[name]).cast("bigint")), INT)
    bad(f"{name} of a {v.kind}")


def to_date(v: Value) -> Value:
    if v.kind == "date":
        return v
    if v.kind == "datetime":
        return Value(utc_date(v.col), DATE)
    if v.known:
        return Value(date_lit(parse_date(v.const)), DATE)
    if v.kind != "string":
        bad(f"date of a {v.kind}")
    return Value(guard(~v.col.rlike(r"^\d{4}-\d\d-\d\d$"), "the text is not a date", v.col.cast("date"), DATE), DATE)


def to_datetime(v: Value) -> Value:
    if v.kind == "datetime":
        return v
    if v.kind != "string":
        bad(f"datetime of a {v.kind}")
    if v.known:
        instant = parse_datetime(v.const)
        return Value(datetime_lit(*instant), DATETIME, extra={"instant": instant})
    pattern = r"^(\d{4}-\d\d-\d\d)[Tt](\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?([Zz]|[+-]\d\d:\d\d)?$"
    get = lambda i: F.regexp_extract(v.col, pattern, i)
    seconds = F.unix_seconds(F.concat(get(1), F.lit(" "), get(2), F.lit("+00:00")).cast("timestamp"))
    zone = get(4)
    off = F.when(zone == "", F.lit(None).cast("int")).when(F.upper(zone) == "Z", F.lit(0)).otherwise((F.when(zone.startswith("-"), -1).otherwise(1) * (F.substring(zone, 2, 2).cast("int") * 3600 + F.substring(zone, 5, 2).cast("int") * 60)).cast("int"))
    nanos = (seconds - F.coalesce(off, F.lit(0))).cast("bigint") * SECOND + F.rpad(get(3), 9, "0").cast("bigint")
    return Value(guard(~v.col.rlike(pattern), "the text is not a date and time", F.when(v.col.isNotNull(), F.struct(nanos.alias("nanos"), off.alias("off"))), DATETIME), DATETIME)


def to_duration(v: Value) -> Value:
    if v.kind == "duration":
        return v
    if v.kind != "string":
        bad(f"duration of a {v.kind}")
    if v.known:
        return Value(duration_lit(*parse_duration(v.const)), DURATION)
    pattern = r"^([+-]?)P(?=.)(?:(\d+)W|(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)D)?(?:T(?=.)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)(?:\.(\d{1,9}))?S)?)?)$"
    get = lambda i: F.coalesce(F.nullif(F.regexp_extract(v.col, pattern, i), F.lit("")), F.lit("0")).cast("bigint")
    sign = F.when(F.regexp_extract(v.col, pattern, 1) == "-", -1).otherwise(1).cast("bigint")
    frac = F.rpad(F.regexp_extract(v.col, pattern, 9), 9, "0").cast("bigint")
    d = duration(sign * (get(3) * 12 + get(4)), sign * (get(2) * 7 + get(5)), sign * ((get(6) * 3600 + get(7) * 60 + get(8)) * SECOND + frac))
    return Value(guard(~v.col.rlike(pattern), "the text is not a duration", F.when(v.col.isNotNull(), d), DURATION), DURATION)


def date_text(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM-dd")


def _fraction_text(n: Column) -> Column:
    return F.when(n == 0, "").otherwise(F.concat(F.lit("."), F.rtrim(F.lpad(n.cast("string"), 9, "0"), F.lit("0"))))


def datetime_text(v: Column) -> Column:
    local = local_nanos(v)
    within = F.pmod(local, F.lit(DAY).cast("bigint"))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    clock = F.concat(two(_floor_div(within, 3600 * SECOND)), F.lit(":"), two(F.pmod(_floor_div(within, 60 * SECOND), F.lit(60).cast("bigint"))), F.lit(":"), two(F.pmod(_floor_div(within, SECOND), F.lit(60).cast("bigint"))))
    off = v["off"]
    zone = F.when(off.isNull(), "").when(off == 0, "Z").otherwise(F.concat(F.when(off < 0, "-").otherwise("+"), two(F.floor(F.abs(off) / 3600)), F.lit(":"), two(F.floor(F.abs(off) % 3600 / 60))))
    return F.concat(date_text(local_date(v)), F.lit("T"), clock, _fraction_text(F.pmod(within, F.lit(SECOND).cast("bigint"))), zone)
