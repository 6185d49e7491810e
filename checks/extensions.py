"""User callbacks."""

from __future__ import annotations

import pandas as pd

from checks.base import registry, sql
from revlens.model import LINE
from revlens.operators import extend
from revlens.sources import adapters

ENTRIES, check = registry()


@check(sql("docs", "SELECT id, author, CAST(length(message) AS BIGINT) AS chars, contains(message, chr(10)) AS multiline FROM docs"))
def udx1_map(spark, folder):
    def describe(pdf):
        out = pdf[["id", "author"]].copy()
        out["chars"] = pdf["message"].str.len()
        out["multiline"] = pdf["message"].str.contains("\n", regex=False)
        return out

    revs = adapters.documents_log(spark, folder).revisions.select("id", "author", "message")
    return extend.map_revisions(revs, describe, "id string, author string, chars bigint, multiline boolean")


@check(sql("rev", "SELECT repo, branch, count(*) AS commits, min(date) AS first, max(date) AS last FROM rev GROUP BY 1, 2"))
def udx2_fold(spark, folder):
    keys = list(LINE)

    def fold(pdf):
        return pdf.groupby(keys, as_index=False).agg(commits=("date", "size"), first=("date", "min"), last=("date", "max"))

    def merge(pdf):
        return pdf.groupby(keys, as_index=False).agg(commits=("commits", "sum"), first=("first", "min"), last=("last", "max"))

    revs = adapters.order_revisions(spark, folder).select(*LINE, "date")
    return extend.fold_by(revs, keys, fold, merge, "repo string, branch string, commits bigint, first bigint, last bigint")


@check(
    sql(
        "rev",
        """WITH g AS (SELECT repo, branch, message, seq, row_number() OVER (PARTITION BY repo, branch ORDER BY seq)
    - row_number() OVER (PARTITION BY repo, branch, message ORDER BY seq) AS k FROM rev),
n AS (SELECT repo, branch, message, k, count(*) AS n FROM g GROUP BY ALL)
SELECT repo, branch, CAST(sum(n) AS BIGINT) AS commits, max(n) AS longest FROM n GROUP BY 1, 2""",
    )
)
def udx2_fold_in_order(spark, folder):
    """The longest run of commits with one message: a fold that depends on the log's order."""

    def row(pdf, runs):
        first, last = runs[0], runs[-1]
        found = {c: [pdf[c].iloc[0]] for c in LINE}
        found |= {"first": [first[0]], "first_n": [first[1]], "last": [last[0]], "last_n": [last[1]]}
        return pd.DataFrame({**found, "commits": [sum(n for *_, n in runs)], "longest": [max(best for _, _, best, _ in runs)], "whole": [len(runs) == 1]})

    def fold(pdf):
        runs = []
        for message in pdf["message"]:
            n = runs[-1][1] + 1 if runs and runs[-1][0] == message else 1
            if n > 1:
                runs[-1] = (message, n, n, n)
            else:
                runs.append((message, 1, 1, 1))
        return row(pdf, runs)

    def merge(pdf):
        out = None
        for r in pdf.to_dict("records"):
            if out is None:
                out = r
                continue
            joined = out["last_n"] + r["first_n"] if out["last"] == r["first"] else 0
            out = {
                **out,
                "first_n": joined if joined and out["whole"] else out["first_n"],
                "last": r["last"],
                "last_n": joined if joined and r["whole"] else r["last_n"],
                "commits": out["commits"] + r["commits"],
                "longest": max(out["longest"], r["longest"], joined),
                "whole": bool(out["whole"] and r["whole"] and joined),
            }
        return pd.DataFrame([out])

    revs = adapters.order_revisions(spark, folder).select(*LINE, "seq", "message")
    schema = "repo string, branch string, first string, first_n long, last string, last_n long, commits long, longest long, whole boolean"
    return extend.fold_in_order(revs, list(LINE), fold, merge, schema).select(*LINE, "commits", "longest")
