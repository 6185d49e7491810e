import zlib

from revlens.functions import paths, text, times

# This and the tables below are results that must match.
DIRNAMES = {
    "": ".", ".": ".", "..": ".", "../.": "..", "/": "/", "../../ab": "../..", "/ab/cd/ef/gh.ij": "/ab/cd/ef",
    "ab/cd": "ab", "/absolute": "/", "relative": ".", "./rel": ".", "/ab/cd/ef/": "/ab/cd", "reldir/": ".",
}
# Fixed values.
BASENAMES = {
    "": "", ".": ".", "..": "..", "../.": ".", "/": "/", "../../ab": "ab", "/ab/cd/ef/gh.ij": "gh.ij",
    "ab/cd": "cd", "/absolute": "absolute", "relative": "relative", "./rel": "rel", "/ab/cd/ef/": "ef", "reldir/": "reldir",
}


def test_dirname(column_of):
    assert column_of(paths.dirname, list(DIRNAMES.items()), "i string, o string") == []


def test_basename(column_of):
    assert column_of(paths.basename, list(BASENAMES.items()), "i string, o string") == []


def test_extension_and_language(column_of):
    rows = [
        ("a/b.C", ".c", "C/C++"), ("x.tar.gz", ".gz", "GZ"), (".gitignore", None, "unknown"), ("dir.d/file", None, "unknown"),
        ("a.b.", ".b.", "B."), ("plain", None, "unknown"), ("Makefile.am", ".am", "Autotools"), ("s/x.PHP5", ".php5", "PHP"),
    ]
    assert column_of(paths.extension, [(a, b) for a, b, _ in rows], "i string, o string") == []
    assert column_of(paths.language, [(a, c) for a, _, c in rows], "i string, o string") == []
    assert len(paths.LANGUAGES) == 39 and len(set(paths.LANGUAGES.values())) == 21


def test_display_directory(column_of):
    assert column_of(paths.display_directory, [("/", "/"), ("/src/lib", "src/lib")], "i string, o string") == []


def test_shorten_path(column_of):
    rows = [
        ("short", 10, "short     "), ("exactly_10", 10, "exactly_10"), ("one/two/three/four.c", 16, ".../three/four.c"),
        ("no_slash_in_this_name", 10, "...is_name"),
    ]
    assert column_of(paths.shorten_path, rows, "i string, w int, o string") == []


def test_trim(column_of):
    rows = [("", ""), ("0", "0"), (" ab", "ab"), ("ab  ", "ab"), (" ab ", "ab"), ("\tab  \n", "ab"), ("   \t", "")]
    assert column_of(text.trim, rows, "i string, o string") == []


def test_split(column_of):
    rows = [
        ("", "", [""]), ("", "token", [""]), ("1,2,3", ",", ["1", "2", "3"]), ("1,2,3", "token", ["1,2,3"]),
        ("abc1abc2abc3abc", "abc", ["", "1", "2", "3", ""]), ("1abc2abc3abc ", "abc", ["1", "2", "3", " "]),
        ("defdef", "def", ["", "", ""]), ("defdef", "", list("defdef")), ("a.b", ".", ["a", "b"]),
    ]
    for given, token, want in rows:
        assert column_of(lambda c: text.split(c, token), [(given, want)], "i string, o array<string>") == []


def test_join_and_affixes(column_of):
    for parts, sep, want in [(["a", "a"], "b", "aba"), (["ab"] * 3, "c", "abcabcab"), (["a"] * 3, "bc", "abcabca"), ([], "c", "")]:
        assert column_of(lambda c: text.join(c, sep), [(parts, want)], "i array<string>, o string") == []
    starts = [("test", "te", True), ("test", "fe", False), ("test", "test", True), ("test", "testing", False), ("", "", True), ("", "test", False), ("test", "", True)]
    ends = [("test", "st", True), ("test", "at", False), ("test", "test", True), ("test", "atest", False), ("", "", True), ("", "test", False), ("test", "", True)]
    for given, part, want in starts:
        assert column_of(lambda c: text.starts_with(c, part), [(given, want)], "i string, o boolean") == []
    for given, part, want in ends:
        assert column_of(lambda c: text.ends_with(c, part), [(given, want)], "i string, o boolean") == []


def test_ids_and_authors(column_of):
    assert column_of(text.child_id, [("a:b", "b"), ("x", "x")], "i string, o string") == []
    assert column_of(text.parent_id, [("a:b", "a"), ("x", None)], "i string, o string") == []
    rows = [("Ann B <a@b> 12 +0000", "Ann B"), ("Odd <x> Name <m@x>", "Odd <x> Name"), (" no mail ", "no mail")]
    assert column_of(text.clean_author, rows, "i string, o string") == []


def test_message_summary(column_of):
    rows = [
        ("one", "one"), ("one\ntwo", "one"), ("one\ntwo\n\nbody", "one    two"), ("  padded \n\nx", "padded"), ("", ""), ("\n\nx", ""), ("\ttab\n", "tab"),
    ]
    assert column_of(text.message_summary, rows, "i string, o string") == []


def test_escaping(column_of):
    assert column_of(text.escape_legacy_csv, [('a,"b"\n\r\t\\', '"a\\,\\"b\\"\\n\\r\t\\"')], "i string, o string") == []
    assert column_of(text.quote_csv, [('a,"b"\n\r\t\\', '"a\\,\\"b\\"\\n\\r\\t\\\\"')], "i string, o string") == []
    assert column_of(text.quote_json, [('a,"b"\n', '"a,\\"b\\"\\n"')], "i string, o string") == []


def test_change_bar(column_of):
    rows = [(1, 15, 100, 1), (100, 15, 100, 15), (50, 15, 100, 7), (0, 15, 100, 0), (1, 1, 1, 1), (0, 1, 1, 0)]
    assert column_of(lambda i, w, m: text.bar_length(i, w, m), rows, "i bigint, w bigint, m bigint, o bigint") == []


def test_summary_line(column_of):
    rows = [
        (1, 24, 0, " 1 file changed, 24 insertions(+)"), (1, 0, 1, " 1 file changed, 1 deletion(-)"),
        (3, 1, 12, " 3 files changed, 1 insertion(+), 12 deletions(-)"), (0, 0, 0, " 0 files changed"),
    ]
    assert column_of(text.summary_line, rows, "f bigint, a bigint, r bigint, o string") == []


def test_crc32(column_of):
    rows = [(bytes(40), 0xE9EC3DB1), (b"\xff" * 40, 0x8CD04C73), (bytes(range(40)), 0x0DA62E3C), (b"text", zlib.crc32(b"text"))]
    assert column_of(text.crc32, rows, "i binary, o bigint") == []


def test_human_distance(column_of):
    minute, day = 60, 86400
    year = 365 * day
    rows = [
        (4, "less than 5 seconds"), (5, "less than 10 seconds"), (10, "less than 20 seconds"), (20, "half a minute"), (39, "half a minute"),
        (40, "less than a minute"), (60, "1 minute"), (89, "1 minute"), (90, "2 minutes"), (44 * minute, "44 minutes"), (45 * minute, "about 1 hour"),
        (89 * minute, "about 1 hour"), (90 * minute, "about 1 hours"), (1439 * minute, "about 23 hours"), (1440 * minute, "1 day"), (2529 * minute, "1 day"),
        (2530 * minute, "1 days"), (3 * day, "3 days"), (43199 * minute, "29 days"), (43200 * minute, "about 1 month"), (86399 * minute, "about 1 month"),
        (86400 * minute, "2 months"), (525599 * minute, "12 months"), (year, "about 1 year"), (year + 131400 * minute, "over 1 year"),
        (year + 394200 * minute, "over 1 years"), (2 * year, "about 2 years"), (2 * year + 200 * day, "over 2 years"),
    ]
    assert column_of(times.human_distance, rows, "i bigint, o string") == []


def test_ordinal(column_of):
    ends = {1: "st", 2: "nd", 3: "rd", 21: "st", 22: "nd", 23: "rd", 31: "st"}
    rows = [(n, f"{n}{ends.get(n, 'th')}") for n in range(1, 32)]
    assert column_of(times.ordinal, rows, "i int, o string") == []


def test_age_phrase(column_of):
    day = 86400
    rows = [
        (0, "0 seconds old"), (1, "one second old"), (59, "59 seconds old"), (60, "one minute old"), (120, "2 minutes old"), (2699, "44 minutes old"),
        (2700, "0 hours old"), (7200, "2 hours old"), (day, "1 days old"), (27 * day, "27 days old"), (28 * day, "1 months old"), (60 * day, "2 months old"),
        (364 * day, "11 months old"), (365 * day, "1 year old"), (731 * day, "2 years old"),
    ]
    assert column_of(times.age_phrase, rows, "i bigint, o string") == []


def _epoch(text):
    from revlens.plans.params import parse_date

    return parse_date(text)


def test_slots_and_labels(column_of):
    new_year = _epoch("2021-01-01") + 3600  # a Friday
    leap = _epoch("2020-02-29") + 86399  # a Saturday
    slots = {
        "days": [(new_year, "2021-01-01"), (leap, "2020-02-29")],
        "weeks": [(new_year, "2020-12-27"), (leap, "2020-02-23")],
        "months": [(new_year, "2021-01-01"), (leap, "2020-02-01")],
        "years": [(new_year, "2021-01-01"), (leap, "2020-01-01")],
    }
    for unit, rows in slots.items():
        assert column_of(lambda c: times.time_slot(c, unit), [(a, _epoch(b)) for a, b in rows], "i bigint, o bigint") == []
    labels = {"days": "2020-02-29", "weeks": "Week 9, 2020", "months": "Feb 20", "years": "2020"}
    for unit, want in labels.items():
        assert column_of(lambda c: times.slot_label(c, unit), [(leap, want)], "i bigint, o string") == []
    after = {"days": "2020-03-01", "weeks": "2020-03-07", "months": "2020-03-29", "years": "2021-03-01"}
    for unit, want in after.items():
        assert column_of(lambda c: times.next_slot(c, unit), [(leap, _epoch(want) + 86399)], "i bigint, o bigint") == []


def test_clock_and_parse(column_of):
    moment = _epoch("2024-01-07") + 13 * 3600 + 45 * 60 + 59  # a Sunday
    assert column_of(times.weekday, [(moment, 0)], "i bigint, o int") == []
    assert column_of(times.hour, [(moment, 13)], "i bigint, o int") == []
    assert column_of(times.hour_of_day, [(moment, 13.75)], "i bigint, o double") == []
    assert column_of(times.parse_date, [("2020-02-29", 1582934400)], "i string, o bigint") == []


def test_next_birthday(column_of):
    as_of = _epoch("2021-06-15")
    rows = [
        (_epoch("2019-06-16") + 5, _epoch("2021-06-16") + 5), (_epoch("2019-06-14"), _epoch("2022-06-14")), (_epoch("2020-02-29"), _epoch("2022-03-01")),
    ]
    assert column_of(lambda c: times.next_birthday(c, as_of), rows, "i bigint, o bigint") == []
