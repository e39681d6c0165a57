"""Nested records of findings for the web: projections of joined rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_CONTEXT = "Dřívější vystoupení téhož řečníka"  # fixed value


def _claim_view(claim: Column, message: Column) -> Column:
    said = F.btrim(F.concat_ws(" ", *[F.coalesce(claim[k], F.lit("")) for k in ("subject", "predicate", "object")]))
    text = lambda c: F.coalesce(c, F.lit(""))
    return F.struct(
        text(claim["rawSpan"]).alias("quote"), said.alias("statement"), text(claim["timeFrame"]).alias("time_frame"), message["message_id"].alias("message_id"),
        message["speaker"].alias("speaker"), message["person"].alias("person"), message["party"].alias("party"), message["date"].alias("date"), text(message["url"]).alias("url"),
    )


def lead_records(leads: DataFrame, messages: DataFrame) -> DataFrame:
    """Two-sided leads: pair_id, contradiction and similarity (four digits), side_a and side_b.

    leads has pair_id, the scores, message_a, message_b and the structs claim_a, claim_b (subject,
    predicate, object, timeFrame, rawSpan); messages has message_id (unique), speaker, person,
    party, date and url. A lead that lacks one of its messages goes; missing texts are empty.
    """
    m = messages.select("message_id", F.struct("message_id", "speaker", "person", "party", "date", "url").alias("m"))
    a, b = m.withColumnsRenamed({"message_id": "message_a", "m": "_a"}), m.withColumnsRenamed({"message_id": "message_b", "m": "_b"})
    return leads.join(a, "message_a").join(b, "message_b").select(
        "pair_id", F.round("contradiction", 4).alias("contradiction"), F.round("similarity", 4).alias("similarity"),
        _claim_view(F.col("claim_a"), F.col("_a")).alias("side_a"), _claim_view(F.col("claim_b"), F.col("_b")).alias("side_b"),
    )


def candidate_record(claim: Column, past: Column, past_date: Column, past_url: Column, past_title: Column, contradiction: Column, no_frame: str) -> Column:
    """Candidate annotation of a pair of claims: label of 40-character prefixes; the past date falls back to the past claim's time frame, the address to ''."""
    text = lambda c: F.coalesce(c, F.lit(""))
    short = lambda c: F.substring(text(c["rawSpan"]), 1, 40)
    filled = lambda c: F.when(c != "", c)
    proof = F.struct(
        text(past["rawSpan"]).alias("pastQuote"), F.coalesce(filled(past_date), past["timeFrame"], F.lit(no_frame)).alias("pastDate"),
        F.coalesce(filled(past_title), F.lit(NO_CONTEXT)).alias("pastContext"), text(past_url).alias("sourceUrl"),
    )
    return F.struct(
        F.lit("CONTRADICTION_TIME").alias("type"), F.lit("MEDIUM").alias("severity"), F.concat(short(claim), F.lit(" vs "), short(past)).alias("shortBadgeLabel"), text(claim["rawSpan"]).alias("targetSnippet"),
        F.coalesce(contradiction, F.lit(0.5)).alias("confidenceScore"), F.lit("CONTRADICTION").alias("nliRelation"), proof.alias("proof"),
    )


def program_record(pledge: Column, chapter: Column, bill: Column, final: Column, reason: Column, groups: Column, chapter_base: str, bill_base: str) -> Column:
    """A pledge of a programme with the final vote on the bill that it is paired with.

    pledge: id, quote; chapter: id, place, title; bill: number, title; final: ballot, url, number,
    session, date, result, passed; groups: the tallies of the groups. The id is made of pledge and ballot.
    """
    return F.struct(
        F.concat(F.lit("pv-"), pledge["id"].cast("string"), F.lit("-"), final["ballot"].cast("string")).alias("id"), pledge["id"].alias("pledge_id"),
        F.struct(chapter["id"].alias("chapter"), chapter["place"].alias("place"), chapter["title"].alias("title"), pledge["quote"].alias("quote"), F.concat(F.lit(chapter_base + "#"), chapter["id"].cast("string")).alias("url")).alias("pledge"),
        F.struct(bill["number"].alias("number"), bill["title"].alias("title"), F.concat(F.lit(bill_base), bill["number"].cast("string")).alias("url")).alias("bill"),
        F.struct(*[final[k].alias(k) for k in ("ballot", "url", "number", "session", "result", "passed")], F.coalesce(final["date"].cast("string"), F.lit("")).alias("date")).alias("final"),
        reason.alias("reason"), groups.alias("groups"),
    )
