"""Dates and instants. "Now" is always an argument."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..dims import MONTHS_LONG, MONTHS_SHORT, WEEKDAYS_LONG

PORTAL_ZONE = "America/Sao_Paulo"
OLDEST, AHEAD = 946684800, 2 * 86400


def civil_day(seconds: Column, zone: str = PORTAL_ZONE) -> Column:
    """'YYYY-MM-DD' of an instant in the portal's time zone; the session's zone must be UTC."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(seconds), zone), "yyyy-MM-dd")


def rfc822_seconds(text: Column, now: Column) -> Column:
    """Instant of 'EEE, d MMM yyyy HH:mm:ss z'; now where it is missing, broken, before 2000 or over two days ahead."""
    found = F.unix_timestamp(F.try_to_timestamp(F.trim(F.substring_index(text, ", ", -1)), F.lit("d MMM yyyy HH:mm:ss z")))
    return F.when((found >= OLDEST) & (found <= now + AHEAD), found).otherwise(now)


def days_between(a: Column, b: Column) -> Column:
    return F.coalesce(F.datediff(F.try_to_timestamp(b).cast("date"), F.try_to_timestamp(a).cast("date")), F.lit(0))


def _local(seconds: Column, zone: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(seconds), zone)


def _name(names: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), at)


def iso(seconds: Column) -> Column:
    """'2024-01-31T00:00:00.000Z'."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def rfc822(seconds: Column) -> Column:
    """'Wed, 31 Jan 2024 00:00:00 GMT'."""
    return F.date_format(F.timestamp_seconds(seconds), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


def long_date(seconds: Column, zone: str = PORTAL_ZONE) -> Column:
    """'31 de janeiro de 2024' in the portal's time zone."""
    at = _local(seconds, zone)
    return F.concat(F.day(at).cast("string"), F.lit(" de "), _name(MONTHS_LONG, F.month(at)), F.lit(" de "), F.year(at).cast("string"))


def short_date(seconds: Column, zone: str = PORTAL_ZONE) -> Column:
    """'31 jan'."""
    at = _local(seconds, zone)
    return F.concat(F.day(at).cast("string"), F.lit(" "), _name(MONTHS_SHORT, F.month(at)))


def short_instant(seconds: Column, zone: str = PORTAL_ZONE) -> Column:
    """'31 jan, 14:32'."""
    return F.concat(short_date(seconds, zone), F.lit(", "), F.date_format(_local(seconds, zone), "HH:mm"))


def full_day(seconds: Column, zone: str = PORTAL_ZONE) -> Column:
    """'Quarta-feira, 31 de janeiro de 2024'."""
    return F.concat(_name(WEEKDAYS_LONG, F.dayofweek(_local(seconds, zone))), F.lit(", "), long_date(seconds, zone))


def portal_year(seconds: Column, zone: str = PORTAL_ZONE) -> Column:
    return F.year(_local(seconds, zone))
