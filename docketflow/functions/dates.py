"""Source dates with three-valued zones, and calendar arithmetic in the schedule's zone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEDULE_ZONE = "America/Sao_Paulo"
SCHEDULE_HOUR = 6

_COMPACT = r"^([0-9]{4})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})([0-9]{2})$"
_OFFSET = r"(Z|[+-][0-9]{2}(:?[0-9]{2})?)"
_TIME = r" [0-9]{2}(:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?)?"
_DAY = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
# A text of this shape is in plain form already.
_PLAIN = rf"^{_DAY} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}(Z|[+-][0-9]{{2}}:[0-9]{{2}})?$"


@dataclass(frozen=True)
class SourceDate:
    """Expressions for one source date text."""

    wall: Column  #: the wall-clock reading without zone, NULL when unreadable
    instant: Column  #: the UTC instant, only when the text names an offset
    aware: Column  #: whether the text names an offset and is readable


def readable(text: Column, date_only: bool = True) -> Column:
    """The text in one plain form, NULL when it is no date text.

    Compact digits get their separators, a bare hour gets minutes, an offset gets a colon.
    ``date_only`` allows a text without a time of day.
    """
    plain = F.translate(F.regexp_replace(text, _COMPACT, "$1-$2-$3 $4:$5:$6"), ",T", ". ")
    shape = f"^{_DAY}({_TIME}{_OFFSET}?)?$" if date_only else f"^{_DAY}{_TIME}{_OFFSET}?$"
    timed = F.regexp_replace(plain, rf"^({_DAY} [0-9]{{2}}(:[0-9]{{2}})?)({_OFFSET}?)$", "$1:00:00$3")
    seconds = F.regexp_replace(timed, r"( [0-9]{2}:[0-9]{2}:00):00", "$1")
    offset = F.regexp_replace(
        F.regexp_replace(seconds, r"( .*[+-][0-9]{2})$", "$1:00"), r"( .*[+-][0-9]{2})([0-9]{2})$", "$1:$2"
    )
    return F.when(plain.rlike(_PLAIN), plain).when(plain.rlike(shape), offset)


def parsed(plain: Column) -> SourceDate:
    """Wall clock, instant and awareness of a text in plain form. Never assumes a zone."""
    has_offset = plain.rlike(rf" .*{_OFFSET}$")
    wall = F.regexp_replace(plain, rf"( .*?){_OFFSET}$", "$1").try_cast("timestamp_ntz")
    return SourceDate(
        wall=wall,
        instant=F.when(has_offset, plain.try_cast("timestamp")),
        aware=F.coalesce(has_offset & wall.isNotNull(), F.lit(False)),
    )


def parse(text: Column, date_only: bool = True) -> SourceDate:
    """Both steps at once, for a single use; larger plans keep the plain form in a column."""
    return parsed(readable(text, date_only))


def iso_micros(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def iso_z(moment: Column) -> Column:
    """ISO text of an instant with Z; the fraction is written only when there is one."""
    fraction = F.date_format(moment, "SSSSSS")
    base = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(base, F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z"))


def status(schema: Column, wall: Column, aware: Column) -> Column:
    """missing, null, timezone_aware, timezone_ambiguous or unparseable.

    ``schema`` is the schema of the JSON value, NULL for a missing one; ``wall`` and ``aware`` come
    from its parsed text.
    """
    return (
        F.when(schema.isNull(), "missing")
        .when(schema == "VOID", "null")
        .when((schema != "STRING") | wall.isNull(), "unparseable")
        .when(aware, "timezone_aware")
        .otherwise("timezone_ambiguous")
    )


def regressed(previous: Column, current: Column) -> Column:
    """Whether a date went back; comparable only when both or neither name an offset."""
    before, after = parse(previous), parse(current)
    both_known = before.wall.isNotNull() & after.wall.isNotNull()
    earlier = F.when(after.aware, after.instant < before.instant).otherwise(after.wall < before.wall)
    went_back = F.coalesce(both_known & (before.aware == after.aware) & earlier, F.lit(False))
    # Most observations have nothing before them, or the same date: nothing is parsed for those.
    return F.when(F.coalesce(previous != current, F.lit(False)), went_back).otherwise(F.lit(False))


def local_date(moment: Column) -> Column:
    """The schedule's calendar date of an instant."""
    return F.to_date(F.from_utc_timestamp(moment, SCHEDULE_ZONE))


def scheduled_instant(day: Column) -> Column:
    """06:00 of a calendar date in the schedule's zone, as an instant."""
    return F.to_utc_timestamp(
        F.to_timestamp(F.concat(day.cast("string"), F.lit(f" {SCHEDULE_HOUR:02d}:00:00"))), SCHEDULE_ZONE
    )


def next_daily_run(moment: Column) -> Column:
    """The next 06:00 strictly after an instant; exactly 06:00 gives the day after."""
    today = scheduled_instant(local_date(moment))
    return F.when(today > moment, today).otherwise(scheduled_instant(F.date_add(local_date(moment), 1)))


def local_minute_label(moment: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(moment, SCHEDULE_ZONE), "dd/MM/yyyy HH:mm")


def months_before(day: Column, months: int) -> Column:
    """The same day of an earlier month, clamped to that month's last day."""
    return F.add_months(day, -months)


def rolling_window(moment: Column, months: int = 12) -> tuple[Column, Column]:
    """From ``months`` ago to the local date of the instant, which is left out."""
    end = local_date(moment)
    return months_before(end, months), end


def inclusive_window(first: Column, last: Column) -> tuple[Column, Column]:
    """An inclusive last day as a half-open range."""
    return first, F.date_add(last, 1)
