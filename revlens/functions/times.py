"""Calendar functions over epoch seconds, always in UTC.

All of them are arithmetic on the epoch value and on DATEs, so that the session
time zone cannot change a result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400
RESOLUTIONS = ("days", "weeks", "months", "years")


def to_date(epoch: Column) -> Column:
    return F.date_from_unix_date(F.floor(epoch / DAY).cast("int"))


def to_epoch(date: Column) -> Column:
    return F.unix_date(date).cast("long") * DAY


def epoch_of(stamp: Column) -> Column:
    """Epoch seconds of a zone-less timestamp, read as UTC."""
    clock = F.hour(stamp) * 3600 + F.minute(stamp) * 60 + F.second(stamp)
    return F.unix_date(stamp.cast("date")).cast("long") * DAY + clock.cast("long")


def parse_date(text: Column) -> Column:
    """'YYYY-MM-DD' to epoch seconds."""
    return to_epoch(F.to_date(text, "yyyy-MM-dd"))


def local_epoch(epoch: Column, sign: Column, hours: Column, minutes: Column) -> Column:
    """Wall-clock epoch from a UTC epoch and a signed offset."""
    return epoch + sign * (hours * 3600 + minutes * 60)


def weekday(epoch: Column) -> Column:
    """0 = Sunday."""
    return F.dayofweek(to_date(epoch)) - 1


def hour(epoch: Column) -> Column:
    return F.floor(F.pmod(epoch, F.lit(DAY)) / 3600).cast("int")


def hour_of_day(epoch: Column) -> Column:
    """Hour with the minutes as a fraction; seconds are dropped."""
    minutes = F.floor(F.pmod(epoch, F.lit(DAY)) / 60)
    return F.floor(minutes / 60) + F.pmod(minutes, F.lit(60)) / 60


def _slot_date(date: Column, resolution: str) -> Column:
    if resolution == "days":
        return date
    if resolution == "weeks":
        return F.date_sub(date, F.dayofweek(date) - 1)
    if resolution in ("months", "years"):
        return F.trunc(date, resolution[:-1])
    raise ValueError(f"unknown resolution {resolution!r}")


def time_slot(epoch: Column, resolution: str) -> Column:
    """Start of the day, Sunday week, month or year the time falls in."""
    return to_epoch(_slot_date(to_date(epoch), resolution))


def next_slot(epoch: Column, resolution: str) -> Column:
    """The same time of day one day, week, month or year later."""
    date = to_date(epoch)
    if resolution == "days":
        later = F.date_add(date, 1)
    elif resolution == "weeks":
        later = F.date_add(date, 7)
    elif resolution in ("months", "years"):
        # a day the target month lacks runs over into the month after it
        step = 1 if resolution == "months" else 12
        later = F.date_add(F.add_months(F.trunc(date, "month"), step), F.dayofmonth(date) - 1)
    else:
        raise ValueError(f"unknown resolution {resolution!r}")
    return to_epoch(later) + F.pmod(epoch, F.lit(DAY))


def slot_label(epoch: Column, resolution: str) -> Column:
    date = to_date(epoch)
    if resolution == "days":
        return date.cast("string")
    if resolution == "weeks":
        week = F.floor(1 + F.dayofyear(date) / 7).cast("string")
        return F.concat(F.lit("Week "), week, F.lit(", "), F.year(date).cast("string"))
    if resolution == "months":
        return F.date_format(date, "MMM yy")
    if resolution == "years":
        return F.year(date).cast("string")
    raise ValueError(f"unknown resolution {resolution!r}")


def human_distance(seconds: Column) -> Column:
    """A span of seconds in words."""
    minutes = F.floor(seconds / 60 + 0.5)
    hours, days, months, years = (F.floor(minutes / unit) for unit in (60, 1440, 43200, 525600))
    rest = F.pmod(minutes - F.floor(years / 4) * 1440, F.lit(525600))

    def words(before: str, n: Column, after: str) -> Column:
        return F.concat(F.lit(before), n.cast("string"), F.lit(after))

    def in_years(before: str) -> Column:
        return F.when(years == 1, words(before, years, " year")).otherwise(words(before, years, " years"))

    # The thresholds and phrases of the distance vocabulary.
    short = (
        F.when(seconds < 5, "less than 5 seconds")
        .when(seconds < 10, "less than 10 seconds")
        .when(seconds < 20, "less than 20 seconds")
        .when(seconds < 40, "half a minute")
        .when(seconds < 60, "less than a minute")
        .otherwise("1 minute")
    )
    return (
        F.when(minutes < 2, short)
        .when(minutes < 45, words("", minutes, " minutes"))
        .when(minutes < 90, F.lit("about 1 hour"))
        .when(minutes < 1440, words("about ", hours, " hours"))
        .when(minutes < 2530, F.lit("1 day"))
        .when(minutes < 43200, words("", days, " days"))
        .when(minutes < 86400, F.lit("about 1 month"))
        .when(minutes < 525600, words("", months, " months"))
        .when(rest < 131400, in_years("about "))
        .when(rest < 394200, in_years("over "))
        .otherwise(words("over ", years, " years"))
    )


def ordinal(number: Column) -> Column:
    """1st, 2nd, 3rd, 4th ... 11th, 12th, 13th ... 21st."""
    digit = number % 10
    ending = (
        F.when((digit == 1) & (number != 11), "st")
        .when((digit == 2) & (number != 12), "nd")
        .when((digit == 3) & (number != 13), "rd")
        .otherwise("th")
    )
    return F.concat(number.cast("string"), ending)


def month_and_day(epoch: Column) -> Column:
    """'March 3rd'."""
    date = to_date(epoch)
    return F.concat(F.date_format(date, "MMMM"), F.lit(" "), ordinal(F.dayofmonth(date)))


def age_phrase(span: Column) -> Column:
    """'3 days old': the largest elapsed unit of a non-negative span of seconds."""
    elapsed = to_date(span)
    years = F.year(elapsed) - 1970
    # Thresholds and phrases.

    def count(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit} old"))

    return (
        F.when(span == 1, F.lit("one second old"))
        .when(span < 60, count(span, "seconds"))
        .when(span < 120, F.lit("one minute old"))
        .when(span < 45 * 60, count(F.floor(span / 60), "minutes"))
        .when(span < DAY, count(F.floor(span / 3600), "hours"))
        .when(span < 28 * DAY, count(F.floor(span / DAY), "days"))
        .when(span < 365 * DAY, count(F.greatest(F.month(elapsed) - 1, F.lit(1)), "months"))
        .when(years == 1, F.lit("1 year old"))
        .otherwise(count(years, "years"))
    )


def next_birthday(born: Column, as_of: int) -> Column:
    """Epoch of the next return of the calendar day and time of day of ``born``."""
    birth = to_date(born)
    clock = F.pmod(born, F.lit(DAY))

    def in_year(year: Column) -> Column:
        first = F.make_date(year, F.month(birth), F.lit(1))
        return to_epoch(F.date_add(first, F.dayofmonth(birth) - 1)) + clock

    this_year = F.year(to_date(F.lit(as_of).cast("long")))
    return F.when(in_year(this_year) < as_of, in_year(this_year + 1)).otherwise(in_year(this_year))
