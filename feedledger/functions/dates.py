"""Date expressions: lenient parsing, window bounds, expiry tests.

``now`` is always passed in by the caller, so a run can be repeated exactly.
"""

from datetime import datetime

from pyspark.sql import Column, functions as F

from ..schemas import (
    READ_RETENTION_MONTHS, STALE_HOURS, TOMBSTONE_HOURS, WINDOW_HOURS,
)
from .urls import let

# Months as they are abbreviated, and named zone offsets in minutes.
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_ZONES = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
}

_ZONE = r"(Z|UTC?|GMT|[ECMP][SD]T|(?:GMT|UTC)?[+\-]\d{2}:?\d{2})?"
_CLOCK = r"(?:[T ]\s*(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?"
_MONTH_NAME = (r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?")
_ISO = rf"(?i)^(\d{{4}})[-/](\d{{1,2}})(?:[-/](\d{{1,2}}))?{_CLOCK}\s*{_ZONE}$"
_DAY_FIRST = (rf"(?i)^(?:[a-z]{{3,9}}\.?,?\s+)?(\d{{1,2}})[\s\-]+{_MONTH_NAME},?[\s\-]+"
              rf"(\d{{4}}),?{_CLOCK}\s*{_ZONE}(?:\s*\(.*\))?$")
_MONTH_FIRST = (rf"(?i)^(?:[a-z]{{3,9}}\.?,?\s+)?{_MONTH_NAME}\s+(\d{{1,2}}),?\s+"
                rf"(\d{{4}}),?{_CLOCK}\s*{_ZONE}(?:\s*\(.*\))?$")


def now_literal(now: datetime | str | Column) -> Column:
    """``now`` as a timestamp Column; strings and naive datetimes are UTC."""
    if isinstance(now, Column):
        return now
    text = now.strftime("%Y-%m-%d %H:%M:%S.%f") if isinstance(now, datetime) else str(now)
    return F.lit(text).cast("timestamp")


def _fields(pattern: str, order: str) -> str:
    """Capture groups of one pattern as an array in a given order, or NULL: one pass."""
    return (f"transform(array(split(regexp_replace(t, r'{pattern}', '{order}'), '[|]')), "
            "f -> if(size(f) = 8, f, NULL))[0]")


_ZONE_MINUTES = ", ".join(f"'{k}', {v}" for k, v in {"": 0, **_ZONES}.items())
# The patterns leave digits or nothing in a numeric group, so plain casts do; a failing
# try_cast would build an exception per row.
_OFFSET = f"""coalesce(
    try_element_at(map({_ZONE_MINUTES}), upper(f[7])),
    transform(array(regexp_replace(f[7], '(?i)^(?:GMT|UTC)|:', '')), z -> if(startswith(z, '-'), -1, 1)
      * (CAST(substr(z, 2, 2) AS INT) * 60 + CAST(substr(z, 4, 2) AS INT)))[0])"""


def _number(group: int, default: int) -> str:
    return f"if(f[{group}] = '', {default}, CAST(f[{group}] AS INT))"


_NUMBERS = f"""
f -> if(f IS NULL, NULL, named_struct(
  'y', {_number(0, 1970)},
  'mo', if(f[1] < 'A', {_number(1, 0)},
           CAST((locate(lower(substr(f[1], 1, 3)), '{_MONTHS}') + 2) / 3 AS INT)),
  'd', {_number(2, 1)}, 'h', {_number(3, 0)}, 'mi', {_number(4, 0)}, 's', {_number(5, 0)},
  'us', if(f[6] = '', 0, CAST(rpad(substr(f[6], 1, 6), 6, '0') AS INT)), 'off', {_OFFSET}))"""
# Plain UTC arithmetic: a day past the end of a month runs into the next one, as a lenient
# date parser does, and no parser policy or session zone can interfere.
_INSTANT = """
n -> if(n.mo BETWEEN 1 AND 12 AND n.d BETWEEN 1 AND 31 AND n.h <= 24 AND n.mi < 60 AND n.s < 60,
  timestamp_micros((CAST(unix_date(make_date(n.y, n.mo, 1)) + n.d - 1 AS BIGINT) * 86400
                    + n.h * 3600 + (n.mi - n.off) * 60 + n.s) * 1000000 + n.us),
  NULL)"""
#: Groups in the order year, month, day, hour, minute, second, fraction, zone.
_GROUPS = f"""t -> coalesce(
  {_fields(_ISO, "$1|$2|$3|$4|$5|$6|$7|$8")},
  {_fields(_DAY_FIRST, "$3|$2|$1|$4|$5|$6|$7|$8")},
  {_fields(_MONTH_FIRST, "$3|$1|$2|$4|$5|$6|$7|$8")})"""


def trustworthy_timestamp(text: Column) -> Column:
    """Instant written in ``text``; NULL when it is not a date we recognise.

    Accepts ISO 8601, RFC 822 and month-name forms. A weekday is read over, never
    checked, because publishers get it wrong. Without a zone the time is UTC.
    """
    return let(let(let(F.trim(text), _GROUPS), _NUMBERS), _INSTANT)


def date_basis(published: Column) -> Column:
    return F.when(published.isNotNull(), F.lit("published")).otherwise(F.lit("discovered"))


def item_date(published: Column, now) -> Column:
    """UTC day of the publication instant, or of the run when there is none."""
    return F.to_date(F.coalesce(published, now_literal(now)))


def add_calendar_months(ts: Column, months: int) -> Column:
    """Add months, clamping to the last day of the target month; keeps time of day."""
    return ts + F.make_ym_interval(F.lit(0), F.lit(months))


def window_start(last_run_at: Column, initial_sync_from: Column, now) -> Column:
    """Lower bound of what a run accepts from a source.

    No cursor: the approved first-sync date. Otherwise the earlier of the cursor and
    the overlap, so a long pause is recovered without a separate path.
    """
    overlap = now_literal(now) - F.expr(f"INTERVAL {WINDOW_HOURS} HOURS")
    return (F.when(last_run_at.isNull(), initial_sync_from.cast("timestamp"))
            .otherwise(F.least(last_run_at, overlap)))


def is_live_tombstone(state: Column, ignored_at: Column, now) -> Column:
    """Ignored less than the tombstone life ago (strict)."""
    live = (state == "ignored") & (
        now_literal(now) < ignored_at + F.expr(f"INTERVAL {TOMBSTONE_HOURS} HOURS"))
    return F.coalesce(live, F.lit(False))


def is_dead_tombstone(state: Column, ignored_at: Column, now) -> Column:
    return F.coalesce(state == "ignored", F.lit(False)) & ~is_live_tombstone(state, ignored_at, now)


def is_read_expired(state: Column, read_at: Column, now) -> Column:
    """Read at least the retention period ago (inclusive)."""
    expired = (state == "read") & (
        now_literal(now) >= add_calendar_months(read_at, READ_RETENTION_MONTHS))
    return F.coalesce(expired, F.lit(False))


def is_stale(last_run_at: Column, now) -> Column:
    return now_literal(now) > last_run_at + F.expr(f"INTERVAL {STALE_HOURS} HOURS")
