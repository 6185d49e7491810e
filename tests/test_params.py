import pytest

from revlens.plans import params
from revlens.plans.params import parse_date
from revlens.sinks import dumps

AS_OF = parse_date("2021-03-17") + 40000  # a Wednesday


@pytest.mark.parametrize(
    "period, start",
    [
        ("1d", "2021-03-17"), ("3days", "2021-03-15"), ("1w", "2021-03-14"), ("2weeks", "2021-03-07"), ("1m", "2021-03-01"), ("4months", "2020-12-01"),
        ("12months", "2020-04-01"), ("1y", "2021-01-01"), ("3years", "2019-01-01"),
    ],
)
def test_period_start(period, start):
    assert params.period_start(AS_OF, period) == parse_date(start)


@pytest.mark.parametrize("period", ["0d", "x", "3", "3parsecs", "-1d"])
def test_bad_periods(period):
    with pytest.raises(ValueError):
        params.period_start(AS_OF, period)


def test_count_resolution():
    day = 86400
    cases = {14: "days", 15: "weeks", 89: "weeks", 90: "months", 729: "months", 730: "years"}
    for days, want in cases.items():
        assert params.count_resolution(days * day) == want
    assert params.count_resolution(day, "y") == "years"
    with pytest.raises(ValueError):
        params.count_resolution(day, "fortnights")


def test_participation_resolution():
    day = 86400
    cases = {45: "days", 46: "weeks", 364: "weeks", 365: "days", 410: "days", 411: "weeks", 545: "weeks", 546: "months", 1825: "months", 1826: "years"}
    for days, want in cases.items():
        assert params.participation_resolution(days * day) == want


def test_volume_slots():
    got = params.volume_slots(AS_OF, "all,d,3days,w,2w,12m,m,2months,y,2years")
    assert got == [
        ("All Time", None), ("Today", parse_date("2021-03-17")), ("Past 3 days", parse_date("2021-03-15")), ("This week", parse_date("2021-03-14")),
        ("Past 2 weeks", parse_date("2021-03-07")), ("Past 12 months", parse_date("2020-04-01")), ("This month", parse_date("2021-03-01")),
        ("Past 2 months", parse_date("2021-02-01")), ("This year", parse_date("2021-01-01")), ("Past 2 years", parse_date("2020-01-01")),
    ]
    with pytest.raises(ValueError):
        params.volume_slots(AS_OF, "3fortnights")


def test_column_codes():
    assert dumps.parse_codes("id,a,+,-,d,t,f,m") == ["id", "author", "added", "removed", "delta", "total", "files", "message"]
    assert dumps.dump_header() == "# Timestamp, Author, Line delta, Total lines"
    with pytest.raises(ValueError):
        dumps.parse_codes("a,z")
