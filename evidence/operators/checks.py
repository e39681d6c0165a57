"""Checks of a sitting day's tables against the record's pages, ballots and registers, as one report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import flat_space
from . import temporal as T
from .gates import Check, check_report
from .votes import reconcile


def _bad(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(True))


def page_checks(speeches: DataFrame, page: DataFrame) -> dict[str, Check]:
    """Anchors, persons and texts of speeches against the pages, and whether the pages hold as many speeches.

    speeches: day, pos, turn, anchor_verified, url, anchor, title, person, text. page: day, turn, url,
    anchor, label, person, text. Only what passed one check goes to the next; texts are alike if
    their common beginning of at most 200 characters is, without a mark of continuation.
    """
    shown = page.select("url", "anchor", F.col("label").alias("_label"), F.col("person").alias("_person"), F.col("text").alias("_text")).dropDuplicates(["url", "anchor"])
    found = speeches.join(shown, ["url", "anchor"], "left")
    verified = F.coalesce("anchor_verified", F.lit(False))
    same = verified & F.coalesce(F.col("_label") == F.col("title"), F.lit(False))
    plain = lambda c: F.regexp_replace(flat_space(F.col(c)), r"[\s*]+$", "")
    ours, theirs = plain("text"), plain("_text")
    n = F.least(F.length(ours), F.length(theirs), F.lit(200))
    alike = (n > 0) & (F.substring(ours, F.lit(1), n) == F.substring(theirs, F.lit(1), n))
    span = speeches.groupBy("day").agg(F.count(F.lit(1)).alias("_spoken"), F.min("turn").alias("_first"), F.max("turn").alias("_last"))
    counted = page.join(span, "day").where(F.col("turn").between(F.col("_first"), F.col("_last"))).groupBy("day").agg(F.count(F.lit(1)).alias("_shown"))
    return {
        "anchor on a page": Check(found, ~verified),
        "anchor of the same speaker": Check(found, _bad(F.col("_label") != F.col("title")), when=verified),
        "person of the anchor": Check(found, _bad(F.col("person") != F.col("_person")), when=same & (F.col("_person") != "")),
        "text of the page": Check(found, ~F.coalesce(alike, F.lit(False)), when=same),
        "coverage of the day": Check(span.join(counted, "day", "left"), F.coalesce("_shown", F.lit(0)) != F.col("_spoken")),
    }


def time_checks(speeches: DataFrame, mentions: DataFrame, ballots: DataFrame) -> dict[str, Check]:
    """Times in order (60 s of rounding pass), ballots of the day's sitting, and ballots within the speech that names them (does not block).

    speeches: day, date, session, pos, second. mentions: day, pos, ballot. ballots: ballot,
    session, date, second.
    """
    times = T.order_check(speeches, "day", ["pos"], "second")
    later = Window.partitionBy("day").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    span = speeches.select(
        "day", "pos", F.col("date").alias("_date"), F.col("session").alias("_session"), F.col("second").alias("_start"), F.first("second", ignorenulls=True).over(later).alias("_following"),
    )
    named = mentions.join(span, ["day", "pos"])
    named = named.join(ballots.dropDuplicates(["ballot"]), "ballot")
    late = ~F.col("date").between(F.col("_date"), F.date_add("_date", 1))
    placed = T.within_window(named.where("_start is not null and second is not null"), "second", "_start", "_following")
    return {
        "times in order": Check(times, F.col("verdict").isin("missing", "problem")),
        "ballot of this sitting": Check(named.select("ballot", "day", "session", "_session", "date", "_date").distinct(), _bad(F.col("session") != F.col("_session")) | F.coalesce(late, F.lit(False))),
        "ballot within the speech": Check(placed, ~F.col("in_window"), False),
    }


def vote_checks(votes: DataFrame, ballots: DataFrame, declared: DataFrame, clubs: DataFrame, mentions: DataFrame, facts: DataFrame) -> dict[str, Check]:
    """Clubs of voters against the register, tallies against the declared ones, and facts against both.

    votes: ballot, person, value, club. ballots: ballot, date. declared: ballot, value, declared.
    clubs: person, club, seq, since, until. mentions: day, pos, ballot, person, vote_of_speaker.
    facts: as `votes.to_facts` gives them, CLUB_MEMBERSHIP with the club as literal and VOTE_CAST
    with the value.
    """
    dated = votes.where("club <> ''").select("ballot", "person", "club").join(ballots.select("ballot", "date").dropDuplicates(["ballot"]), "ballot")
    member = T.interval_at(dated.withColumnRenamed("club", "_said"), clubs, "person", "date", "club", "seq")
    differing = reconcile(votes, declared, "ballot", "value").select("ballot", F.lit(True).alias("_bad")).distinct()
    tallies = ballots.select("ballot").distinct().join(differing, "ballot", "left")
    cast = facts.where("predicate = 'VOTE_CAST'").select(F.col("subject").alias("person"), F.col("object").alias("ballot"), F.col("literal").alias("_fact"), "fact_id")
    spoken = mentions.where("person <> '' and vote_of_speaker is not null").select("day", "pos", "person", F.col("ballot").cast("string").alias("ballot"), "vote_of_speaker")
    told = T.fact_for_object(spoken, cast, ["person", "ballot"], "_fact", "fact_id")
    known = facts.where("predicate = 'CLUB_MEMBERSHIP'").select(F.col("subject").alias("person"), F.col("literal").alias("_fact"), "valid_from", "valid_to")
    # one table for the club by the register and by the facts
    member = T.fact_at(member.withColumn("_person", F.col("person").cast("string")), known.withColumnRenamed("person", "_person"), "_person", "date", "_fact")
    return {
        "club of the register": Check(member, ~F.col("club").eqNullSafe(F.col("_said"))),
        "tally as declared": Check(tallies, F.col("_bad").isNotNull()),
        "fact of the vote": Check(told, ~F.col("_fact").eqNullSafe(F.col("vote_of_speaker"))),
        "fact of the club": Check(member, ~F.col("_fact").eqNullSafe(F.col("_said")), when=F.col("date").isNotNull()),
    }


def text_check(messages: DataFrame) -> dict[str, Check]:
    """The first 60 characters of a message's first clean line stand in its raw text. messages: clean, raw; an empty clean text fails."""
    head = F.substring(F.split("clean", "\n", 2)[0], 1, 60)
    return {"clean text of the speech": Check(messages, ~F.coalesce((head != "") & F.col("raw").contains(head), F.lit(False)))}


def source_crosscheck(speeches: DataFrame, page: DataFrame, mentions: DataFrame, ballots: DataFrame, votes: DataFrame, declared: DataFrame, clubs: DataFrame, facts: DataFrame, messages: DataFrame) -> DataFrame:
    """All checks as rows of name, total, problems, ok and blocking. Tables as the single checks say; any may be empty."""
    checks = page_checks(speeches, page) | time_checks(speeches, mentions, ballots) | vote_checks(votes, ballots, declared, clubs, mentions, facts) | text_check(messages)
    return check_report(checks)
