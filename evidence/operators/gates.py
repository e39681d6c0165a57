"""Re-derive stored results from the source data before they are published.

A gate gives the first reason that fails, in a fixed order, or null.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.score import presentation_tier
from ..functions.text import quote_reason
from ..sources.files import saved
from .votes import AGAINST, PRO, agreement


def first_reason(*tests: tuple[Column, str]) -> Column:
    """The text of the first test that is true, or null."""
    return F.coalesce(*[F.when(bad, F.lit(why)) for bad, why in tests])


def gate_agreement(stored: DataFrame, ballots: DataFrame, annulled: DataFrame, votes: DataFrame) -> DataFrame:
    """Stored rows (ballot, person, stance, vote, agreement) with reason and verified.

    In order: ballot missing, ballot annulled, no person, no vote, the direction differs, stored
    a direction where the data have none, the recomputed agreement differs.
    """
    joined = (
        stored.join(ballots.select("ballot", F.lit(True).alias("_known")).distinct(), "ballot", "left")
        .join(annulled.select("ballot", F.lit(True).alias("_annulled")).distinct(), "ballot", "left")
        .join(votes.select("ballot", "person", "data_vote"), ["ballot", "person"], "left")
    )
    vote, data = F.col("vote"), F.col("data_vote")
    reason = first_reason(
        (F.col("_known").isNull(), "ballot missing"),
        (F.col("_annulled").isNotNull(), "ballot annulled"),
        (F.col("person").isNull(), "no person"),
        (data.isNull(), "no vote"),
        (vote.isin(PRO, AGAINST) & data.isin(PRO, AGAINST) & (vote != data), "direction differs"),
        (vote.isin(PRO, AGAINST) & ~data.isin(PRO, AGAINST), "vote without direction"),
        (F.col("agreement") != agreement(F.col("stance"), data), "agreement differs"),
    )
    return joined.withColumn("reason", reason).withColumn("verified", F.col("reason").isNull()).drop("_known", "_annulled")


def gate_approved(gated: DataFrame, approved: Column) -> DataFrame:
    """Approval is required first, then what the gate said."""
    reason = F.when(~F.coalesce(approved, F.lit(False)), "not approved").otherwise(F.col("reason"))
    return gated.withColumn("reason", reason).withColumn("verified", F.col("reason").isNull())


def gate_commitment(stored: DataFrame, chapters: DataFrame, ballots: DataFrame, annulled: DataFrame, tallies: DataFrame, key: list[str], counts: list[str]) -> DataFrame:
    """Stored rows (chapter, quote, ballot, counts) with the first reason.

    In order: chapter missing, quote not in its text, ballot missing, ballot annulled, the
    recomputed counts differ (columns data_<count> of tallies, joined by key).
    """
    text = chapters.select(F.col("chapter").alias("_chapter"), F.col("text").alias("_text"))
    asked = stored.select(F.col("chapter").alias("_chapter"), F.col("quote").alias("_quote")).distinct().join(text, "_chapter")
    within = F.when(F.col("_text").isNotNull(), F.coalesce(F.col("_text").contains(F.col("_quote")), F.lit(False)))
    # each quote is sought in its chapter once, and no text goes further; saved, so that Spark knows its size
    sought = saved(asked.select("_chapter", "_quote", within.alias("_within")), "quotes")
    joined = (
        stored.join(sought, (F.col("chapter") == F.col("_chapter")) & F.col("quote").eqNullSafe(F.col("_quote")), "left")
        .join(ballots.select("ballot", F.lit(True).alias("_known")).distinct(), "ballot", "left")
        .join(annulled.select("ballot", F.lit(True).alias("_annulled")).distinct(), "ballot", "left")
        .join(tallies.select(*key, *[f"data_{c}" for c in counts]), key, "left")
    )
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"data_{c}")) for c in counts])
    reason = first_reason(
        (F.col("_within").isNull(), "chapter missing"),
        (~F.col("_within"), "quote not in text"),
        (F.col("_known").isNull(), "ballot missing"),
        (F.col("_annulled").isNotNull(), "ballot annulled"),
        (differs, "tally differs"),
    )
    return joined.select(*stored.columns, reason.alias("reason"))


def errors_of(rows: DataFrame, tests: dict[str, Column], name: str = "errors") -> DataFrame:
    """Rows with the array of the names of all tests that are true."""
    found = F.array_compact(F.array(*[F.when(bad, F.lit(why)) for why, bad in tests.items()]))
    return rows.withColumn(name, found)


def ballot_ref(text: Column) -> Column:
    """Struct of number, session and date of a ballot named in words; parts that are not there are null."""
    part = lambda pattern, kind: F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast(kind)
    day = F.concat_ws("-", *[F.lpad(F.nullif(F.regexp_extract(text, R.BALLOT_DAY, k), F.lit("")), n, "0") for k, n in ((3, 4), (2, 2), (1, 2))])
    return F.struct(part(R.BALLOT_NUMBER, "string").alias("number"), part(R.BALLOT_SESSION, "int").alias("session"), F.try_to_date(day, "yyyy-MM-dd").alias("date"))


def ballot_ref_reason(ref: Column, number: Column, session: Column, date: Column) -> Column:
    """Why a named ballot is not the one in the records, or null; number, session and date are the record's, null where it has none.

    Without a name there is nothing to check; parts that either side lacks are not compared.
    """
    said = ballot_ref(ref)
    differs = F.concat_ws("; ", F.when(said["session"] != session, "session differs"), F.when(said["date"] != date, "date differs"))
    return F.when(F.btrim(F.coalesce(ref, F.lit(""))) == "", None).when(said["number"].isNull(), "no number").when(number.isNull(), "ballot missing").when(differs != "", differs)


def gate_annotations(annotations: DataFrame, pages: DataFrame, ballots: DataFrame) -> DataFrame:
    """Annotations (proof: a struct of pastQuote, sourceUrl, votingBallotId) with `reason`: no proof, the quote's, else the ballot's.

    pages has url and text, ballots has ballot (text), session and date. All annotations stay, as
    the gate is all or nothing: see `publish_gated`.
    """
    proof = F.col("proof")
    cited = annotations.withColumn("_url", proof["sourceUrl"]).withColumn("_ballot", ballot_ref(proof["votingBallotId"])["number"])
    joined = cited.join(pages.select(F.col("url").alias("_url"), F.col("text").alias("_text")).dropDuplicates(["_url"]), "_url", "left").join(
        ballots.select(F.col("ballot").alias("_ballot"), F.lit(True).alias("_known"), F.col("session").alias("_session"), F.col("date").alias("_date")).dropDuplicates(["_ballot"]), "_ballot", "left"
    )
    empty = F.btrim(F.coalesce(proof["sourceUrl"], F.lit(""))) == ""
    reason = F.coalesce(
        F.when(proof.isNull(), "no proof"), F.when(empty, "no address"), quote_reason(F.col("_text"), F.btrim(proof["pastQuote"])),
        ballot_ref_reason(proof["votingBallotId"], F.when(F.col("_known"), F.col("_ballot")), F.col("_session"), F.col("_date")),
    )
    return joined.select(*annotations.columns, reason.alias("reason"))


def publish_gated(gated: DataFrame, write) -> None:
    """Call write with the annotations, unless one of them has a reason: then raise and write nothing."""
    assert_none(gated.where("reason is not null"), "export stopped")
    write(gated.drop("reason"))


def annotation_errors(a: Column, text: Column) -> Column:
    """All errors of one annotation, a struct, against the text it marks; a missing key ends the list.

    A null is a missing key. Optional parts (confidenceScore, presentationTier, nliRelation,
    claimCategory, mediaEvidence, adversarialCheck) count only where they are there.
    """
    no = lambda c: F.coalesce(c, F.lit("")) == ""
    off = lambda c, known: ~no(c) & ~c.isin(*known)
    missing = F.array_compact(F.array(*[F.when(a[k].isNull(), f"missing {k}") for k in R.ANNOTATION_KEYS]))
    start, end, score, tier = a["start"], a["end"], a["confidenceScore"], a["presentationTier"]
    inside = (start >= 0) & (start <= end) & (end <= F.length(F.coalesce(text, F.lit(""))))
    out_of_range = ~score.between(0.0, 1.0) | F.isnan(score)
    media, proof = a["mediaEvidence"], a["proof"]
    tests = [
        (~a["type"].isin(*R.ANNOTATION_TYPES), "unknown type"), (~a["severity"].isin(*R.SEVERITIES), "unknown severity"), (~inside, "span out of range"),
        (inside & (F.substring(text, start + 1, end - start) != a["targetSnippet"]), "span is not the snippet"),
        (out_of_range, "score out of range"), (~out_of_range & (score < R.LEAST_SCORE), "score too low"),
        (~tier.isin(*R.TIER_NAMES), "unknown tier"), (tier.isin(*R.TIER_NAMES) & (tier != presentation_tier(score)), "tier differs"),
        (off(a["nliRelation"], R.RELATIONS), "unknown relation"), (off(a["claimCategory"], R.CLAIM_CATEGORIES), "unknown category"),
        *[(no(proof[k]), f"proof without {k}") for k in R.PROOF_KEYS], (off(proof["voteRecorded"], R.VOTE_VALUES), "unknown vote"),
        (media.isNotNull() & ~F.coalesce(media["exactTimestampSeconds"] >= 0, F.lit(False)), "bad media time"), (media.isNotNull() & no(media["archiveUrl"]), "media without address"),
        (a["adversarialCheck"].isNotNull() & a["adversarialCheck"]["passed"].isNull(), "check without result"),
    ]
    return F.when(F.size(missing) > 0, missing).otherwise(F.array_compact(F.array(*[F.when(bad, why) for bad, why in tests])))


def debate_errors(debates: DataFrame) -> DataFrame:
    """Debates (columns as in R.DEBATE_KEYS, messages an array of structs) with `errors`: of the debate, else of its messages and their annotations.

    A null is a missing key. Errors of a message begin with its id.
    """
    held = [k for k in R.DEBATE_KEYS if k in debates.columns]
    top = F.array_compact(F.array(*[F.when(F.col(k).isNull(), f"missing {k}") if k in held else F.lit(f"missing {k}") for k in R.DEBATE_KEYS]))

    def of_message(m: Column) -> Column:
        act = m["speechAct"]
        own = F.array_compact(F.array(*[F.when(m[k].isNull(), f"missing {k}") for k in R.MESSAGE_KEYS], F.when((act != "") & ~act.isin(*R.SPEECH_ACTS), "unknown act")))
        nested = F.flatten(F.transform(F.coalesce(m["annotations"], F.array()), lambda a: annotation_errors(a, F.coalesce(m["cleanText"], F.lit("")))))
        return F.transform(F.concat(own, nested), lambda e: F.concat(F.coalesce(m["messageId"], F.lit("?")), F.lit(": "), e))

    return debates.withColumn("errors", F.when(F.size(top) > 0, top).otherwise(F.flatten(F.transform("messages", of_message))) if len(held) == len(R.DEBATE_KEYS) else top)


def assert_none(failures: DataFrame, message: str) -> None:
    """All or nothing: raise if any row fails."""
    one = failures.limit(1).collect()
    if one:
        raise ValueError(f"{message}: {one[0].asDict()}")


def coverage(rows: DataFrame, category: str, expected: list[str], least: int) -> DataFrame:
    """Count of each expected category and whether it is below the minimum."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(x,) for x in expected], f"{category} string")
    counts = rows.groupBy(category).agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(wanted).join(counts, category, "left").select(category, F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) < least).alias("problem"))


class Check(NamedTuple):
    """Rows of a table, a column that is true where a row fails, whether that blocks, and which rows are tested (all)."""

    rows: DataFrame
    bad: Column
    blocks: bool = True
    when: Column | None = None


def check_report(checks: dict[str, Check]) -> DataFrame:
    """One row for each check: name, total, problems, ok, blocking.

    Checks of one DataFrame are counted together in one aggregate, so a table is read once for all of them.
    """
    tables: dict[int, tuple[DataFrame, list]] = {}
    for name, check in checks.items():
        check = Check(*check)
        tables.setdefault(id(check.rows), (check.rows, []))[1].append((name, check))
    reports = []
    for df, tests in tables.values():
        every = [F.lit(True) if c.when is None else F.coalesce(c.when, F.lit(False)) for _, c in tests]
        sums = [x for k, (_, c) in enumerate(tests) for x in (F.count_if(every[k]).alias(f"_total{k}"), F.count_if(every[k] & c.bad).alias(f"_bad{k}"))]
        lines = [F.struct(F.lit(name).alias("name"), F.col(f"_total{k}").alias("total"), F.col(f"_bad{k}").alias("problems"), (F.col(f"_bad{k}") == 0).alias("ok"), F.lit(c.blocks).alias("blocking")) for k, (name, c) in enumerate(tests)]
        reports.append(df.agg(*sums).select(F.inline(F.array(*lines))))
    return reduce(DataFrame.unionByName, reports)


def corpus_regression(rows: DataFrame, group: str, tests: dict[str, Column], found: Column, lost: Column, share: float = 0.01) -> DataFrame:
    """By group: rows, how many fail a test, how many lost text on the way, how many were found, and two alarms.

    alarm: fewer findings than `share` of the rows, though all are analysed; failed: any failing row or lost text.
    """
    checked = errors_of(rows, tests)
    out = checked.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("errors") > 0).alias("failing"), F.count_if(lost).alias("lost"), F.count_if(found).alias("found"))
    return out.withColumn("alarm", F.col("found") < share * F.col("n")).withColumn("failed", (F.col("failing") > 0) | (F.col("lost") > 0))
