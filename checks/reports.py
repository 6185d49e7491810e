"""The reports, end to end."""

from __future__ import annotations

from checks.base import ORDERS_AS_OF, day, label_sql, registry, r6, slot_sql, sql
from checks.functions import ENTRIES as _FUNCTIONS
from checks.functions import AGE_SQL, BIRTHDAY_SQL, HUMAN_SQL, ORDINAL_SQL, _SUMMARY
from checks.joins import SMOOTH_BODY
from checks.sources import ALL_COLUMNS, AT_TAGS, ENTRIES as _SOURCES, REVDUMP_SQL
from checks.totals import LANGUAGES_SQL, PIE_SQL, PUNCH_SQL, _SHARE, _volume_orders_sql
from checks.windows import AUTHORS_SQL, DIRECTORIES_SQL, LOC_SQL
from revlens.operators import lifetimes
from revlens.operators.select import DEFAULT_BRANCH
from revlens.plans import reports
from revlens.sources import adapters

ENTRIES, check = registry()


def _orders(spark, folder):
    return adapters.orders_log(spark, folder)


@check(sql("tot", LOC_SQL))
def rpt1_loc(spark, folder):
    return reports.loc(_orders(spark, folder))


@check(sql("tot", f"SELECT * FROM ({LOC_SQL}) WHERE branch = 'F'"))
def rpt1_loc_default_branch(spark, folder):
    return reports.loc(_orders(spark, folder), branch=DEFAULT_BRANCH)


@check(sql("tot", f"SELECT * FROM ({AUTHORS_SQL}) WHERE date >= 883612800"))
def rpt2_authors(spark, folder):
    return reports.authors(_orders(spark, folder), datemin="1998-01-01")


def _pie_sql(amount, source, top, parts):
    return sql(
        parts,
        PIE_SQL.format(amount=amount, source=source, top=top)
        + f""" SELECT repo, branch, author, rank, round({_SHARE.format('n')}, 6) AS share, round({_SHARE.format('upto - n')}, 6) AS arc_from,
  round({_SHARE.format('upto')}, 6) AS arc_to, CAST(floor(100 * {_SHARE.format('n')} + 0.5) AS BIGINT) AS pct FROM c""",
    )


def _rounded(df, *columns):
    return df.withColumns({c: r6(c) for c in columns})


@check(_pie_sql("1", "ev", 6, "ev"))
def rpt3_authors_pie(spark, folder):
    pie = reports.authors_pie(adapters.events_log(spark, folder))
    return _rounded(pie, "share", "arc_from", "arc_to")


@check(_pie_sql("lines_added", "tot", 6, "tot"))
def rpt3_authors_pie_changes(spark, folder):
    pie = reports.authors_pie(_orders(spark, folder), changes=True)
    return _rounded(pie, "share", "arc_from", "arc_to")


@check(
    sql(
        "ev",
        """WITH act AS (SELECT author, row_number() OVER (ORDER BY count(DISTINCT date) DESC, author) AS k FROM ev WHERE date <> 0 GROUP BY 1),
s AS (SELECT repo, branch, author AS series, date, 1 AS n FROM ev SEMI JOIN (SELECT author FROM act WHERE k <= 6) t USING (author))"""
        + SMOOTH_BODY.replace("AS span FROM s", "AS span FROM ev WHERE date <> 0"),
    )
)
def rpt4_activity_by_author(spark, folder):
    curve = reports.activity(adapters.events_log(spark, folder), "authors")
    return _rounded(curve, "x", "y")


def _slots_sql(source, first, last, unit, sums, shown):
    step = {"days": "1 DAY", "weeks": "7 DAY", "months": "1 MONTH", "years": "1 YEAR"}[unit]
    cols = ", ".join(f"coalesce({c}, 0) AS {c}" for c in shown)
    return f"""WITH spine AS (SELECT repo, branch, CAST(s AS DATE) AS d FROM (SELECT DISTINCT repo, branch FROM {source}),
  generate_series(DATE '{first}', DATE '{last}', INTERVAL {step}) g(s)),
cnt AS (SELECT repo, branch, {slot_sql(day('date'), unit)} AS slot, {sums} FROM {source} GROUP BY 1, 2, 3)
SELECT repo, branch, slot, {label_sql('d', unit)} AS label, {cols}
FROM (SELECT *, CAST(epoch(d) AS BIGINT) AS slot FROM spine) LEFT JOIN cnt USING (repo, branch, slot)"""


@check(sql("tot", _slots_sql("tot", "2000-09-01", "2001-08-01", "months", "count(*) AS commits, CAST(sum(files) AS BIGINT) AS changes", ["commits", "changes"])))
def rpt5_commit_counts(spark, folder):
    return reports.commit_counts(_orders(spark, folder), ORDERS_AS_OF)


@check(sql("tot", _slots_sql("tot", "1995-01-01", "2001-01-01", "years", "count(*) AS commits, CAST(sum(files) AS BIGINT) AS changes", ["commits", "changes"])))
def rpt5_commit_counts_years(spark, folder):
    return reports.commit_counts(_orders(spark, folder), ORDERS_AS_OF, "7y")


_OWN = "CAST(sum(CASE WHEN author = '7' THEN {0} ELSE 0 END) AS BIGINT) AS own, CAST(sum(CASE WHEN author = '7' THEN 0 ELSE {0} END) AS BIGINT) AS others"


@check(sql("tot", _slots_sql("tot", "1999-09-01", "2001-08-01", "months", _OWN.format("lines_added"), ["own", "others"])))
def rpt6_participation(spark, folder):
    return reports.participation(_orders(spark, folder), "7", ORDERS_AS_OF, "24months", changes=True)


@check(sql("rev", _slots_sql("rev", "2000-08-27", "2001-07-29", "weeks", _OWN.format("1"), ["own", "others"])))
def rpt6_participation_commits(spark, folder):
    return reports.participation(_orders(spark, folder), "7", ORDERS_AS_OF)


@check(_volume_orders_sql("1", 6))
def rpt7_volume(spark, folder):
    return _rounded(reports.volume(_orders(spark, folder), ORDERS_AS_OF), "pct")


@check(_volume_orders_sql("lines_added + lines_removed", 6))
def rpt7_volume_changes(spark, folder):
    return _rounded(reports.volume(_orders(spark, folder), ORDERS_AS_OF, changes=True), "pct")


@check(sql("ev", PUNCH_SQL.format(where="WHERE date <> 0 AND author = '7'")))
def rpt8_punchcard(spark, folder):
    return _rounded(reports.punchcard(adapters.events_log(spark, folder), author="7"), "size")


@check(sql("ev", "SELECT repo, branch, id, date, round(date // 3600 % 24 + (date // 60 % 60) / 60.0, 6) AS hour_of_day FROM ev WHERE date <> 0"))
def rpt9_times(spark, folder):
    return _rounded(reports.commit_times(adapters.events_log(spark, folder)), "hour_of_day")


@check(sql("fc", f"SELECT * FROM ({DIRECTORIES_SQL}) WHERE date >= 883612800"))
def rpt10_directories(spark, folder):
    return reports.directories(_orders(spark, folder), datemin="1998-01-01")


@check(
    sql(
        "tree",
        f"""{LANGUAGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, language) AS k, sum(n) OVER (PARTITION BY repo) AS total FROM lang),
b AS (SELECT *, max(k) OVER (PARTITION BY repo) AS last, max(CASE WHEN language = 'unknown' THEN k END) OVER (PARTITION BY repo) AS spot FROM r WHERE k <= 6),
p AS (SELECT repo, language, n, CAST(CASE WHEN spot IS NULL THEN k WHEN k = spot THEN last WHEN k = last THEN spot ELSE k END AS INTEGER) AS rank, total FROM b
  UNION ALL SELECT repo, 'Other', CAST(sum(n) AS BIGINT), 7, max(total) FROM r WHERE k > 6 GROUP BY 1)
SELECT repo, language, n, rank, round(CAST(n AS DOUBLE) / CAST(total AS DOUBLE), 6) AS share FROM p""",
    )
)
def rpt11_filetypes(spark, folder):
    return _rounded(reports.filetypes(adapters.pages_log(spark, folder), pie=True), "share")


@check(
    sql(
        "docs",
        f"SELECT repo, branch, author, count(*) OVER (PARTITION BY repo, branch, author) AS n, seq, '      ' || {_SUMMARY} AS line FROM docs WHERE author <> ''",
    )
)
def rpt12_shortlog(spark, folder):
    return reports.shortlog(adapters.documents_log(spark, folder))


@check(
    sql(
        "conv",
        """SELECT repo, branch, author, count(*) AS n, CASE WHEN count(*) < 100000 THEN lpad(CAST(count(*) AS VARCHAR), 6, ' ') ELSE CAST(count(*) AS VARCHAR) END
  || chr(9) || author AS line FROM conv WHERE author <> '' GROUP BY 1, 2, 3""",
    )
)
def rpt12_shortlog_summary(spark, folder):
    return reports.shortlog(adapters.conversations_log(spark, folder), summary=True, numbered=True)


DIFFSTAT_SQL = """WITH l AS (SELECT repo, id, max(length(path)) AS len, max(lines_added + lines_removed) AS big FROM fc GROUP BY 1, 2),
w AS (SELECT repo, id, big, CASE WHEN 70 - len < 15 THEN 55 ELSE len END AS nw, least(CASE WHEN 70 - len < 15 THEN 15 ELSE 70 - len END, big) AS gw FROM l),
f AS (SELECT rev.repo, branch, id, seq, path, lines_added AS la, lines_removed AS lr, big, nw, gw FROM fc JOIN w USING (repo, id) JOIN rev USING (repo, id))
SELECT repo, branch, id, seq, CAST(0 AS INTEGER) AS part, path, ' ' || rpad(path, CAST(nw AS INTEGER), ' ') || ' | ' || lpad(CAST(la + lr AS VARCHAR), 4, ' ') || ' '
  || repeat('+', CASE WHEN big >= 2 THEN CAST(floor(((la - 1) * (gw - 1) + big - 1) / CAST(big - 1 AS DOUBLE)) AS BIGINT) ELSE la END)
  || repeat('-', CASE WHEN big >= 2 THEN CAST(floor(((lr - 1) * (gw - 1) + big - 1) / CAST(big - 1 AS DOUBLE)) AS BIGINT) ELSE lr END) AS line FROM f
UNION ALL SELECT repo, branch, id, seq, 1, '', ' ' || files || ' files changed, ' || lines_added || ' insertions(+), ' || lines_removed || ' deletions(-)' FROM tot"""


@check(sql("tot", DIFFSTAT_SQL))
def rpt13_diffstat(spark, folder):
    return reports.diffstat(_orders(spark, folder))


@check(
    sql(
        "tot",
        f"""WITH lines AS ({DIFFSTAT_SQL})
SELECT *, row_number() OVER (PARTITION BY repo, branch, id ORDER BY part, path) AS ordinal FROM lines""",
    )
)
def rpt13_diffstat_numbered(spark, folder):
    return reports.diffstat(_orders(spark, folder), numbered=True)


@check(
    sql(
        "tot",
        """SELECT repo, branch, seq, concat_ws(',', date, author, delta, total) AS line FROM (
  SELECT *, lines_added - lines_removed AS delta, CAST(sum(lines_added - lines_removed) OVER (PARTITION BY repo, branch ORDER BY seq) AS BIGINT) AS total FROM tot)
WHERE date >= 883612800""",
    )
)
def rpt14_csv(spark, folder):
    return reports.csv(_orders(spark, folder), datemin="1998-01-01")


@check(_SOURCES["snk2_csv"].sql)
def rpt15_data_csv(spark, folder):
    return reports.data(_orders(spark, folder), "csv", ALL_COLUMNS)


@check(_SOURCES["snk3_json"].sql)
def rpt15_data_json(spark, folder):
    return reports.data(_orders(spark, folder), "json", ALL_COLUMNS)


@check(REVDUMP_SQL)
def rpt16_revdump(spark, folder):
    return reports.revdump(_orders(spark, folder))


@check(
    sql(
        "br",
        """SELECT repo, branch, is_default, head_id, CASE WHEN is_default THEN '* ' ELSE '  ' END
  || rpad(branch, CAST(max(length(branch)) OVER (PARTITION BY repo) + 1 AS INTEGER), ' ') || head_id AS line FROM br""",
    )
)
def rpt17_branches(spark, folder):
    return reports.branch_list(_orders(spark, folder))


@check(sql("tags", "SELECT repo, name, id, rpad(name, CAST(max(length(name)) OVER (PARTITION BY repo) + 2 AS INTEGER), ' ') || id AS line FROM tags"))
def rpt18_tags(spark, folder):
    return reports.tag_list(_orders(spark, folder))


_BORN = day("born")
_NOW = f"{day(str(ORDERS_AS_OF))}"
_MONTH_DAY = "strftime({0}, '%B') || ' ' || " + ORDINAL_SQL.format("day({0})")


@check(
    sql(
        "rev",
        f"""WITH b AS (SELECT repo, date AS born, {ORDERS_AS_OF} - date AS span FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY seq) AS k FROM rev) WHERE k = 1),
n AS (SELECT *, {BIRTHDAY_SQL.format(year=2001, d=_BORN, born='born', now=ORDERS_AS_OF)} - {ORDERS_AS_OF} AS wait FROM b),
a AS (SELECT repo, born, span, {AGE_SQL} AS phrase, wait FROM n),
h AS (SELECT repo, born, phrase, wait AS span, CAST(floor(wait / 60.0 + 0.5) AS BIGINT) AS mins,
  strftime({_BORN}, '%m-%d') = strftime({_NOW}, '%m-%d') AS today, year({_NOW}) - year({_BORN}) AS years FROM a)
SELECT repo, born, CASE WHEN today AND years = 0 THEN '' WHEN today THEN repo || ' is ' || years || CASE WHEN years = 1 THEN ' year old' ELSE ' years old' END
    ELSE repo || ' is ' || phrase END AS age,
  CASE WHEN today THEN 'Happy birthday, ' || repo || '!' ELSE repo || CASE WHEN ends_with(repo, 's') THEN '''' ELSE '''s' END || ' birthday is in ' || {HUMAN_SQL}
    || ' (' || {_MONTH_DAY.format(_BORN)} || ')' END AS next_birthday FROM h""",
    )
)
def rpt19_age(spark, folder):
    return reports.age(_orders(spark, folder), ORDERS_AS_OF)


@check(sql("ev", "SELECT repo, id, 'corrupted' AS status FROM ev WHERE seq % 97 = 0"))
def rpt20_check_cache(spark, folder):
    return reports.check_cache(adapters.event_payloads(spark, folder))


@check(sql("ev", "SELECT repo, id, 'out of date' AS status FROM ev"))
def rpt20_check_cache_old_version(spark, folder):
    return reports.check_cache(adapters.event_payloads(spark, folder), version=3, backend="git")


@check(sql("tags", "SELECT tags.repo, name, date FROM tags JOIN rev USING (repo, id) WHERE regexp_matches(name, '\\.01$')"))
def rpt21_tag_marks(spark, folder):
    return reports.tag_marks(_orders(spark, folder), r"\.01$")


@check(
    sql(
        "fc tags",
        f"""WITH {AT_TAGS}, pl AS (SELECT DISTINCT path, language FROM ({_FUNCTIONS["fn4_language"].sql}))
SELECT repo, branch, "at", name, language, count(*) AS n FROM alive JOIN pl USING (path) GROUP BY 1, 2, 3, 4, 5""",
    )
)
def rpt11_filetypes_at_tags(spark, folder):
    """Files of each language at every tag."""
    log = _orders(spark, folder)
    return lifetimes.languages_at(log, lifetimes.tag_positions(log))
