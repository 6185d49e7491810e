"""The reports. Each takes a ChangeLog and options and returns a DataFrame.

Some store an intermediate that several branches of their plan need, and so run jobs when they are called; the
rest are lazy.

A report answers for every repository and branch of the log at once (one row set
per ``repo`` and ``branch``); ``branch`` narrows it to one branch name or, as
``DEFAULT_BRANCH``, to each repository's default branch. Dates are epoch seconds,
or 'YYYY-MM-DD' where an option says so; ``as_of`` stands for the current time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.functions import paths, text, times
from revlens.model import LINE, REV, ChangeLog
from revlens.operators import ranking, series, store, totals
from revlens.operators import select as sel
from revlens.operators.scan import range_scan
from revlens.plans import params
from revlens.session import written
from revlens.sinks import dumps
from revlens.sources import tables

TOP = 6


def _revisions(log: ChangeLog, branch: str | None, datemin: str | None, datemax: str | None) -> DataFrame:
    return sel.revisions(log, branch, params.parse_date(datemin), params.parse_date(datemax))


def _with_totals(log: ChangeLog, revs: DataFrame, some: bool = False) -> DataFrame:
    return totals.selected_totals(log, revs, some)


def _tagged(log: ChangeLog, points: DataFrame, tags: str | None) -> DataFrame:
    """With a pattern, ``points`` get a column of the names of the tags on their date, comma-separated."""
    if tags is None:
        return points
    marks = tag_marks(log, tags).groupBy("repo", "date").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("tags"))
    return points.join(written(marks, "tag-marks"), ["repo", "date"], "left").select(*points.columns, "tags")


def loc(
    log: ChangeLog, branch: str | None = None, datemin: str | None = None, datemax: str | None = None, tags: str | None = None
) -> DataFrame:
    """Lines of code over time. ``tags``, a pattern, adds the tags on each date."""
    daily = totals.net_by_date(_with_totals(log, _revisions(log, branch, None, datemax), bool(branch or datemax)))
    return _tagged(log, sel.clip_after(series.loc_curve(daily), params.parse_date(datemin)), tags)


def authors(
    log: ChangeLog,
    n: int = TOP,
    branch: str | None = None,
    datemin: str | None = None,
    datemax: str | None = None,
    tags: str | None = None,
) -> DataFrame:
    """Lines added so far by each of the busiest authors, at every commit."""
    history = sel.attributed(_with_totals(log, _revisions(log, branch, None, datemax), bool(branch or datemax)))
    commits = written(history.select(*LINE, "date", "seq", "author", "lines_added"), "author-commits")
    names = series.top_names(totals.lines_by_author(commits), "author", "loc", n)
    points = series.with_names(commits, names)
    points = points.select(*LINE, "date", "seq", *series.member_columns("author", F.col("lines_added"), n))
    return _tagged(log, sel.clip_after(series.top_series(points, names, n, "author", "loc", commits.count()), params.parse_date(datemin)), tags)


def authors_pie(
    log: ChangeLog,
    n: int = TOP,
    changes: bool = False,
    branch: str | None = None,
    datemin: str | None = None,
    datemax: str | None = None,
) -> DataFrame:
    """Share of commits, or of added lines (then from the beginning of history), by author."""
    if changes:
        history = _with_totals(log, _revisions(log, branch, None, datemax), bool(branch or datemax))
        sizes = totals.lines_by_author(history).withColumnRenamed("loc", "n")
    else:
        sizes = totals.commits_by_author(_revisions(log, branch, datemin, datemax)).withColumnRenamed("commits", "n")
    pie = ranking.arcs(ranking.shares(sizes, LINE, "author", "n", n), LINE, "n")
    return pie.select(*LINE, "author", "rank", "share", "arc_from", "arc_to", "pct")


def activity(
    log: ChangeLog,
    split: str = "none",
    changes: bool = False,
    n: int = TOP,
    branch: str | None = None,
    datemin: str | None = None,
    datemax: str | None = None,
    tags: str | None = None,
) -> DataFrame:
    """Smoothed activity curves, of all commits or of the series active on most dates.

    ``tags``, a pattern, adds a row for each tag: its name as series, its date as x, no point and no y.
    """
    revs = _revisions(log, branch, datemin, datemax)
    counts = totals.activity_counts(log, revs, split, changes, bool(branch or datemin or datemax))
    cells = written(series.activity_cells(counts, totals.date_extent(revs)), "activity-cells")
    if totals.split_name(split) != "none":
        active = cells.groupBy(*LINE, "series").agg(F.sum("dates").alias("dates"))
        top = ranking.rank(active, LINE, "dates", ["series"], n)
        cells = ranking.keep_members(cells, top, LINE + ["series"])
    curves = series.smooth_cells(cells)
    if tags is None:
        return curves
    named = sel.filter_tags(log.need("tags"), tags).join(sel.dated(revs).select(*LINE, "id", "date"), REV)
    marks = named.select(*LINE, F.col("name").alias("series"), F.col("date").cast("double").alias("x")).distinct()
    return curves.unionByName(marks, allowMissingColumns=True)


def commit_counts(
    log: ChangeLog, as_of: int, period: str = "12months", resolution: str = "auto", branch: str | None = None
) -> DataFrame:
    """Commits and touched files per slot of the last period."""
    begin = params.period_start(as_of, period)
    unit = params.count_resolution(as_of - begin, resolution)
    start = params.slot_start(begin, unit)
    counts = totals.slot_counts(_with_totals(log, sel.revisions(log, branch, start), some=True), unit)
    return _on_slots(log, branch, counts, start, as_of, unit, ["commits", "changes"])


def participation(
    log: ChangeLog,
    author: str,
    as_of: int,
    period: str = "12months",
    resolution: str = "auto",
    changes: bool = False,
    branch: str | None = None,
) -> DataFrame:
    """Commits, or added lines, of one author and of all others per slot."""
    begin = params.period_start(as_of, period)
    unit = params.participation_resolution(as_of - begin, resolution)
    start = params.slot_start(begin, unit)
    rows = sel.revisions(log, branch, start)
    rows = _with_totals(log, rows, some=True) if changes else rows
    counts = totals.participation(rows, author, unit, changes)
    return _on_slots(log, branch, counts, start, as_of, unit, ["own", "others"])


def _on_slots(log, branch, counts, start, as_of, unit, values) -> DataFrame:
    lines = sel.on_branch(series.history_lines(log), log, branch)
    filled = series.fill_slots(counts, series.slot_spine(lines, start, as_of, unit), values)
    return filled.select(*LINE, "slot", times.slot_label(F.col("slot"), unit).alias("label"), *values)


def volume(
    log: ChangeLog,
    as_of: int,
    slots: str = "all,12m,m",
    n: int = TOP,
    changes: bool = False,
    branch: str | None = None,
) -> DataFrame:
    """Percentage of each author per time slot, the rest as Others.

    A revision counts in every slot it is recent enough for. All slots are summed
    in one pass as conditional columns; authors are ranked by the sum over slots.
    """
    captions = params.volume_slots(as_of, slots)
    rows = sel.revisions(log, branch)
    oldest = None if any(first is None for _, first in captions) else min(first for _, first in captions)
    if changes and oldest is not None:  # of older revisions no change is read
        older = rows.where(F.col("date") < oldest).withColumns({c: F.lit(0).cast("long") for c in totals.TOTALS})
        rows = _with_totals(log, rows.where(F.col("date") >= oldest), True).unionByName(older)
    elif changes:
        rows = _with_totals(log, rows, bool(branch))
    amount = F.col("lines_added") + F.col("lines_removed") if changes else F.lit(1).cast("long")
    cells = [f"s{i}" for i in range(len(captions))]
    sums = [
        F.sum(amount if first is None else F.when(F.col("date") >= first, amount).otherwise(0)).alias(c)
        for c, (_, first) in zip(cells, captions)
    ]
    sizes = rows.groupBy(*LINE, "author").agg(*sums).withColumn("all_slots", sum((F.col(c) for c in cells), F.lit(0)))
    sizes = written(sizes, "author-volumes")
    top = ranking.rank(sizes, LINE, "all_slots", ["author"], n)
    whole = sizes.groupBy(*LINE).agg(*[F.sum(c).alias("t" + c) for c in cells])
    kept = top.groupBy(*LINE).agg(*[F.sum(c).alias(c) for c in cells], F.count("*").cast("int").alias("rank"))
    rest = whole.join(kept, LINE)
    unfilled = F.lit(False)
    for c in cells:
        unfilled = unfilled | (F.col(c) < F.col("t" + c)) | (F.col("t" + c) == 0)
    # an empty slot belongs to Others as a whole
    others = rest.where(unfilled).select(
        *LINE,
        F.lit(ranking.OTHERS).alias("author"),
        (F.col("rank") + 1).alias("rank"),
        *[F.coalesce(ranking.ratio(100.0 * (F.col("t" + c) - F.col(c)), F.col("t" + c)), F.lit(100.0)).alias("p" + c) for c in cells],
    )
    named = top.join(whole, LINE).select(
        *LINE,
        "author",
        "rank",
        *[F.coalesce(ranking.ratio(100.0 * F.col(c), F.col("t" + c)), F.lit(0.0)).alias("p" + c) for c in cells],
    )
    pairs = F.array(
        *[F.struct(F.lit(caption).alias("slot"), F.col("p" + c).alias("pct")) for c, (caption, _) in zip(cells, captions)]
    )
    long = named.unionByName(others).select(*LINE, "author", "rank", F.explode(pairs).alias("cell"))
    return long.select(*LINE, "cell.slot", "author", "rank", "cell.pct")


def punchcard(
    log: ChangeLog,
    author: str | None = None,
    branch: str | None = None,
    datemin: str | None = None,
    datemax: str | None = None,
) -> DataFrame:
    """Commits by weekday and hour."""
    revs = _revisions(log, branch, datemin, datemax)
    return totals.punchcard(revs if author is None else sel.by_author(revs, author))


def commit_times(
    log: ChangeLog, branch: str | None = None, datemin: str | None = None, datemax: str | None = None
) -> DataFrame:
    """Date and time of day of every commit."""
    revs = sel.dated(_revisions(log, branch, datemin, datemax))
    return revs.select(*LINE, "id", "date", times.hour_of_day(F.col("date")).alias("hour_of_day"))


def directories(
    log: ChangeLog,
    n: int = TOP,
    branch: str | None = None,
    datemin: str | None = None,
    datemax: str | None = None,
    tags: str | None = None,
) -> DataFrame:
    """Net lines so far in each of the largest directories, at every commit."""
    revs = _revisions(log, branch, None, datemax).select(*LINE, "id", "date", "seq")
    changes = totals.changes_of(log, revs) if branch or datemax else log.need("file_changes")
    touched = totals.touches(revs, changes).withColumn("directory", totals.directory())
    moves = touched.groupBy(*LINE, "date", "seq", "directory").agg(F.sum(totals.net_lines()).alias("delta"))
    # every commit is a point of the series, also one that touched no file
    points = revs.select(*LINE, "date", "seq", F.lit(None).cast("string").alias("directory"), F.lit(0).cast("long").alias("delta"))
    moves = written(moves.unionByName(points), "directory-moves")
    sizes = moves.where("directory is not null").groupBy(*LINE, "directory").agg(F.sum("delta").alias("loc"))
    names = series.top_names(sizes, "directory", "loc", n)
    # of the others only the points in time are needed, and each commit has a row without a directory for that
    commits = moves.where("directory is null").count()
    per_commit = series.member_sums(moves, names, "directory", "delta", n, commits)
    grid = series.top_series(per_commit, names, n, "directory", "loc", commits)
    shown = grid.withColumn("directory", paths.display_directory(F.col("directory")))
    return _tagged(log, sel.clip_after(shown, params.parse_date(datemin)), tags)


def filetypes(log: ChangeLog, id: str | None = None, n: int = TOP, pie: bool = False) -> DataFrame:
    """Files per language at a revision; 'unknown' trades places with the last one shown.

    The pie has an 'Other' remainder and shares that sum to one.
    """
    counts = totals.files_by_language(tables.tree(log, id))
    if not pie:
        top = ranking.rank(counts, ["repo"], "n", ["language"], n)
        return ranking.swap_last(top, ["repo"], "language", paths.NO_LANGUAGE).select("repo", "language", "n", "rank")
    parts = ranking.top_n_and_others(counts, ["repo"], "language", "n", n, label="Other").where("not is_rest or n > 0")
    kept = ranking.swap_last(parts.where("not is_rest"), ["repo"], "language", paths.NO_LANGUAGE)
    slices = kept.unionByName(parts.where("is_rest"))
    return slices.select("repo", "language", "n", "rank", ranking.ratio(F.col("n"), F.col("total")).alias("share"))


def shortlog(
    log: ChangeLog,
    summary: bool = False,
    numbered: bool = False,
    branch: str | None = None,
    datemin: str | None = None,
    datemax: str | None = None,
) -> DataFrame:
    """Commit count per author, or every message summary under its author.

    Authors come by name, or by commit count when ``numbered``; messages in log
    order. Messages stay one per row, as one author may own a third of them.
    """
    revs = _revisions(log, branch, datemin, datemax)
    order = [F.col("n").desc(), "author"] if numbered else ["author"]
    if summary:
        counts = totals.commits_by_author(revs).withColumnRenamed("commits", "n")
        line = F.concat(paths.pad_left(F.col("n").cast("string"), 6), F.lit("\t"), "author")
        return counts.withColumn("line", line).orderBy(*LINE, *order)
    rows = totals.messages_by_author(revs).withColumnRenamed("commits", "n")
    line = F.concat(F.lit(" " * 6), text.message_summary(F.col("message")))
    return rows.select(*LINE, "author", "n", "seq", line.alias("line")).orderBy(*LINE, *order, "seq")


# Total width, columns kept for the counter, and least graph width
# of the change chart.
WIDTH, RESERVED, MIN_GRAPH = 80, 10, 15


def diffstat(log: ChangeLog, branch: str | None = None, id: str | None = None, numbered: bool = False) -> DataFrame:
    """Change chart of every selected revision: file lines (part 0) and a summary (part 1).

    Sorted by (seq, part, path) the lines are the charts. Widths follow from
    per-revision maxima, which are aggregated and written before they meet the file
    rows. ``numbered`` adds the line's ``ordinal`` in its chart, at the price of a
    sort of all lines.
    """
    revs = sel.on_branch(log.revisions, log, branch)
    if id is not None:
        revs = revs.where(F.col("id") == id)
    # a selection by id or branch is known before any change is read
    if id is not None and log.placed_changes is None:
        changes = log.need("file_changes").where(F.col("id") == id)
    else:
        changes = log.need("file_changes") if id is None and branch is None else totals.changes_of(log, revs)
    revs = revs.select(*LINE, *[c for c in REV if c not in LINE], "seq")
    # both the widths and the lines need the changes, which may be a join of several tables
    changes = written(changes.select(*REV, "path", "lines_added", "lines_removed"), "changes")
    layout = written(revs.join(totals.layout_stats(changes), REV, "left"), "layout")
    room = F.lit(WIDTH - RESERVED) - F.col("max_len")
    cramped = room < MIN_GRAPH
    sized = layout.withColumns(
        {
            "name_width": F.when(cramped, F.lit(WIDTH - RESERVED - MIN_GRAPH)).otherwise(F.col("max_len")),
            "graph_width": F.least(F.when(cramped, F.lit(MIN_GRAPH)).otherwise(room).cast("long"), "max_change"),
        }
    )
    files = changes.join(sized, REV)
    amount = F.col("lines_added") + F.col("lines_removed")
    bars = [
        text.change_bar(mark, F.col(column), F.col("graph_width"), F.col("max_change"))
        for mark, column in (("+", "lines_added"), ("-", "lines_removed"))
    ]
    line = F.concat(
        F.lit(" "), paths.shorten_path(F.col("path"), F.col("name_width")), F.lit(" | "),
        paths.pad_left(amount.cast("string"), 4), F.lit(" "), *bars,
    )
    counts = [F.coalesce(c, F.lit(0)) for c in ("files", "added", "removed")]
    summary = F.format_string(" %d files changed, %d insertions(+), %d deletions(-)", *counts)
    charts = files.select(*LINE, "id", "seq", F.lit(0).alias("part"), "path", line.alias("line"))
    ends = layout.select(*LINE, "id", "seq", F.lit(1).alias("part"), F.lit("").alias("path"), summary.alias("line"))
    lines = charts.unionByName(ends)
    if not numbered:
        return lines
    return range_scan(lines, [*LINE, "id"], ["part", "path"], {"ordinal": ("sum", F.lit(1).cast("long"))})


def csv(log: ChangeLog, columns: str = dumps.DEFAULT_COLUMNS, branch: str | None = None, datemin: str | None = None, datemax: str | None = None) -> DataFrame:
    """Revision lines in the legacy CSV dialect."""
    span = {"datemin": params.parse_date(datemin), "datemax": params.parse_date(datemax)}
    return dumps.dump_csv_legacy(log, columns, branch=branch, **span)


def data(
    log: ChangeLog,
    format: str = "csv",
    columns: str = dumps.DEFAULT_COLUMNS,
    branch: str | None = None,
    datemin: str | None = None,
    datemax: str | None = None,
) -> DataFrame:
    """Revision lines as CSV or JSON."""
    writers = {"csv": dumps.dump_csv, "json": dumps.dump_json}
    if format.lower() not in writers:
        raise ValueError(f"unknown format: {format}")
    span = {"datemin": params.parse_date(datemin), "datemax": params.parse_date(datemax)}
    return writers[format.lower()](log, columns, branch=branch, **span)


def revdump(log: ChangeLog, branch: str | None = None, id: str | None = None) -> DataFrame:
    """Full text dump of revisions."""
    return dumps.revision_dump(log, branch, id)


def branch_list(log: ChangeLog) -> DataFrame:
    """Branches by name with head revision; the default branch is starred."""
    rows = log.need("branches")
    widest = rows.groupBy("repo").agg((F.max(F.length("branch")) + 1).alias("width"))
    star = F.when(F.col("is_default"), "* ").otherwise("  ")
    line = F.concat(star, paths.pad_right(F.col("branch"), F.col("width")), "head_id")
    padded = rows.join(widest, "repo")
    return padded.select(*LINE, "is_default", "head_id", line.alias("line")).orderBy("repo", "branch")


def branch_order(branches: DataFrame) -> DataFrame:
    """Default branch first, then by name."""
    return branches.orderBy("repo", F.when(F.col("is_default"), 0).otherwise(1), "branch")


def tag_list(log: ChangeLog) -> DataFrame:
    """Tags by name with the revision they mark."""
    rows = log.need("tags")
    widest = rows.groupBy("repo").agg((F.max(F.length("name")) + 2).alias("width"))
    line = F.concat(paths.pad_right(F.col("name"), F.col("width")), "id")
    padded = rows.join(widest, "repo")
    return padded.select("repo", "name", "id", line.alias("line")).orderBy("repo", "name")


def age(log: ChangeLog, as_of: int) -> DataFrame:
    """Age of each repository and the time to its next birthday."""
    now = F.lit(as_of).cast("long")
    # staged column by column: each step refers to the one before more than once
    rows = (
        totals.first_revision(log.revisions)
        .withColumn("name", paths.basename(F.col("repo")))
        .withColumn("birthday", times.month_and_day(F.col("born")))
        .withColumn("next", times.next_birthday(F.col("born"), as_of))
        .withColumns({"span": now - F.col("born"), "wait": F.col("next") - now})
        .withColumn("years", F.year(times.to_date(now)) - F.year(times.to_date(F.col("born"))))
        .withColumns({"old": times.age_phrase(F.col("span")), "distance": times.human_distance(F.col("wait"))})
    )
    name, span, years = F.col("name"), F.col("span"), F.col("years")
    today = times.month_and_day(now) == F.col("birthday")
    possessive = F.when(F.endswith(name, F.lit("s")), "'").otherwise("'s")
    # The sentences of the report.
    age_line = (
        F.when(span < 0, F.concat(name, F.lit(" is not born yet!")))
        .when(today & (years == 0), F.lit(""))
        .when(today & (years == 1), F.concat(name, F.lit(" is 1 year old")))
        .when(today, F.concat(name, F.lit(" is "), years.cast("string"), F.lit(" years old")))
        .otherwise(F.concat(name, F.lit(" is "), "old"))
    )
    birthday_line = (
        F.when(span < 0, F.lit(""))
        .when(today, F.concat(F.lit("Happy birthday, "), name, F.lit("!")))
        .otherwise(F.concat(name, possessive, F.lit(" birthday is in "), "distance", F.lit(" ("), "birthday", F.lit(")")))
    )
    return rows.select("repo", "born", age_line.alias("age"), birthday_line.alias("next_birthday"))


def check_cache(stored: DataFrame, version: int = store.STORE_VERSION, backend: str = "git") -> DataFrame:
    """Rows of a store that cannot be used, and why.

    A store of a wrong version is unusable as a whole; otherwise the rows that
    fail their checksum are listed.
    """
    gate = store.version_status(F.lit(version), F.lit(backend))
    status = F.when(gate != store.OK, gate).otherwise(F.col("status"))
    return store.audit(stored).select(*REV, status.alias("status")).where(F.col("status") != store.OK)


def tag_marks(log: ChangeLog, pattern: str | None = None) -> DataFrame:
    """Name and date of each tag, to mark on a time series."""
    chosen = sel.filter_tags(log.need("tags"), pattern).select("repo", "name", "id").distinct()
    dates = log.revisions.select(*REV, "date")
    return chosen.join(dates, REV).select("repo", "name", "id", "date").distinct().select("repo", "name", "date")
