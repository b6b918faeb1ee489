"""Date and time column functions; calendar days are days in the shops' time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Athens"
SOON_DAYS = 2


def micros(at: Column) -> Column:
    """Microseconds since the epoch; a time without a zone is UTC (the session's zone)."""
    return F.unix_micros(at.cast("timestamp"))


def local_day(at: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(at, ZONE))


def days_left(until: Column, now: Column) -> Column:
    """Calendar days from now to until."""
    return F.datediff(local_day(until), local_day(now))


def short_date(at: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(at, ZONE), "dd/MM")


def full_date(at: Column) -> Column:
    return F.date_format(F.from_utc_timestamp(at, ZONE), "dd/MM/yyyy")


def expiry(valid_from: Column, valid_until: Column, updated_at: Column, from_source: Column, now: Column) -> Column:
    """Label of an offer's validity: real dates count down, made-up dates only say when the offer was checked."""
    left = days_left(valid_until, now)
    upcoming = F.coalesce(valid_from > now, F.lit(False))
    urgent = F.coalesce(left.between(0, SOON_DAYS), F.lit(False))
    in_days = lambda before, after: F.concat(F.lit(before), left.cast("string"), F.lit(after))
    status = (
        F.when(left.isNull(), "—").when(left < 0, "Έχει λήξει").when(left == 0, "Τελειώνει σήμερα").when(left == 1, "Τελειώνει αύριο")
        .when(left <= SOON_DAYS, in_days("Τελειώνει σε ", " μέρες")).otherwise(in_days("Σε ", " ημέρες"))
    )
    ends = F.when(left == 0, "Λήγει σήμερα").when(left == 1, "Λήγει αύριο").otherwise(in_days("Λήγει σε ", " μέρες"))
    chip = F.when(upcoming, F.concat(F.lit("Ξεκινά "), short_date(valid_from))).when(urgent, ends).otherwise(F.concat(F.lit("Έως "), short_date(valid_until)))
    real = F.coalesce(from_source, F.lit(False))
    return F.struct(
        real.alias("real"),
        (real & upcoming).alias("upcoming"),
        (real & urgent).alias("urgent"),
        F.when(real, left).alias("days_left"),
        F.when(real, chip).alias("chip"),
        F.when(real, status).otherwise("Σε ισχύ").alias("status"),
        F.when(real, F.concat(F.lit("έως "), full_date(valid_until))).otherwise(F.concat(F.lit("ελέγχθηκε "), full_date(updated_at))).alias("status_sub"),
        F.when(real, full_date(valid_from)).alias("start_full"),
    )


def recency_boost(created_at: Column, now: Column) -> Column:
    """2 points for a new row, less 0.2 a day."""
    days = (micros(now) - micros(created_at)) / 86_400_000_000
    return F.when(created_at.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 2 - F.greatest(F.lit(0.0), days) * 0.2))


def next_sunday_end(now: Column) -> Column:
    """The last millisecond of the coming Sunday (today, if it is one), UTC."""
    day = F.to_date(now)
    sunday = F.when(F.dayofweek(day) == 1, day).otherwise(F.next_day(day, "Sun"))
    return sunday.cast("timestamp") + F.expr("INTERVAL '23:59:59.999' HOUR TO SECOND")


def badge_dates(text: Column, now: Column) -> Column:
    """Struct of the two dates of 'dd.MM. - dd.MM.'; a second date before the first is in the next year."""
    part = lambda i: F.regexp_extract(text, r"(\d{1,2})\.(\d{1,2})\.?\s*[-–]\s*(\d{1,2})\.(\d{1,2})\.?", i).try_cast("int")
    year = F.year(now)
    a, b = F.try_make_timestamp(year, part(2), part(1), F.lit(0), F.lit(0), F.lit(0)), F.try_make_timestamp(year, part(4), part(3), F.lit(23), F.lit(59), F.lit(59))
    late = F.try_make_timestamp(year + 1, part(4), part(3), F.lit(23), F.lit(59), F.lit(59))
    return F.struct(a.alias("valid_from"), F.when(b < a, late).otherwise(b).alias("valid_until"))


def expired_by_ttl(created_at: Column, ttl_days: Column, now: Column) -> Column:
    return F.coalesce(F.timestamp_add("DAY", ttl_days, created_at) < now, F.lit(False))
