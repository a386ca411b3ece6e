"""Dates and times against a given moment, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expiry_badge(expiration: Column, today: Column) -> Column:
    """"Expired" up to and on the day, "Exp Nd" for three days, then the date; null without a date."""
    day = F.try_to_date(expiration)
    left = F.datediff(day, today)
    return F.when(left <= 0, "Expired").when(left <= 3, F.concat(F.lit("Exp "), left.cast("string"), F.lit("d"))).when(day.isNotNull(), F.concat(F.lit("Exp "), F.date_format(day, "MMM d")))


def time_ago(moment: Column, now: Column) -> Column:
    """Minutes, hours or days ago, from a week on the date."""
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    minutes = F.floor((micros(now) - micros(moment)) / 60_000_000)
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    text = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(minutes < 60, text(minutes, "m")).when(hours < 24, text(hours, "h")).when(days < 7, text(days, "d")).otherwise(F.date_format(moment, "MMM d"))


def iso(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")


def local_date(moment: Column) -> Column:
    """The day as a card shows it, in the session's time zone."""
    return F.date_format(moment, "MMM d, yyyy")


def file_stamp(moment: Column) -> Column:
    """The part of a picture's file name that tells when it came."""
    return F.date_format(moment, "yyyyMMdd_HHmmss")
