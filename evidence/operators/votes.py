"""Records to agenda items to ballots to votes: joins, tallies and agreement.

Vote codes map to PRO and PROTI; any other code means abstained, absent or unknown, and each
tally says what it does with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import saved

PRO, AGAINST = "PRO", "PROTI"


def direction(code: Column, pro: str, against: str) -> Column:
    """PRO, PROTI or, for any other code, JINAK."""
    return F.when(code == pro, PRO).when(code == against, AGAINST).otherwise("JINAK")


def record_to_item(probes: DataFrame, records: DataFrame, anchor: list[str], person: str, order: list[str], columns: list[str]) -> DataFrame:
    """Each probe with the columns of its record.

    The record table is unique on the anchor alone, so of several records the last by `order`
    stays; only then must the person agree.
    """
    last = records.groupBy(*anchor).agg(F.max_by(F.struct(person, *columns), F.struct(*order)).alias("r"))
    last = last.select(*anchor, *[F.col(f"r.{c}").alias(c) for c in [person, *columns]])
    return probes.join(last, [*anchor, person])


def votes_for_item(ballots: DataFrame, wanted: DataFrame, key: list[str], annulled: DataFrame | None, ballot: str) -> DataFrame:
    """Ballots of the wanted items; annulled ones, if given, are left out."""
    out = ballots.join(wanted.select(*key).distinct(), key, "left_semi")
    return out if annulled is None else out.join(annulled.select(ballot).distinct(), ballot, "left_anti")


def final_votes(claims: DataFrame, finals: DataFrame, bill: str, session: str, order: str, columns: list[str], last: bool = False) -> DataFrame:
    """Each claim with a final vote of its bill: the one of its own session, else the first (or last) by order.

    Sessions are joined by set, so that claims of a second session of one bill are not lost.
    """
    pick = F.max_by if last else F.min_by
    whole = F.struct(session, *columns, F.col(order).alias("_order"))
    own = finals.groupBy(bill, session).agg(pick(whole, order).alias("own"))
    any_ = own.groupBy(bill).agg(pick("own", "own._order").alias("any"))  # the finals are read and shuffled once
    found = claims.join(own, [bill, session], "left").join(any_, bill, "left").withColumn("f", F.coalesce("own", "any"))
    return found.select(*claims.columns, F.col(f"f.{session}").alias(f"final_{session}"), *[F.col(f"f.{c}").alias(c) for c in columns])


def linked_finals(claims: DataFrame, ballots: DataFrame, annulled: DataFrame, ballot: str, links: str | None = None, sessions: tuple[str, str] | None = None) -> DataFrame:
    """Claims whose final vote may stand: a known ballot that is not annulled.

    links, an array of the ballots that the bill's page names, must hold the ballot where it is
    not empty; sessions, two columns, must agree (the claim's and the final vote's session).
    """
    out = claims.where(F.col(ballot).isNotNull())
    if links is not None:
        out = out.where((F.coalesce(F.size(F.array_compact(links)), F.lit(0)) <= 0) | F.array_contains(links, F.col(ballot)))
    if sessions is not None:
        out = out.where(F.col(sessions[0]) == F.col(sessions[1]))
    return out.join(ballots.select(ballot).distinct(), ballot, "left_semi").join(annulled.select(ballot).distinct(), ballot, "left_anti")


def one_vote(votes: DataFrame, ballot: Column, person: Column, code: Column, pro: str, against: str, name: str = "vote") -> DataFrame:
    """ballot, person and the direction of the person's vote; of several the first by name (JINAK, PRO, PROTI).

    Codes are numbers while they are aggregated, so that Spark can hash in place instead of sorting.
    """
    number = F.when(code == pro, 1).when(code == against, 2).otherwise(0)
    one = votes.groupBy(ballot.alias("ballot"), person.alias("person")).agg(F.min(number).alias("_n"))
    return one.select("ballot", "person", F.when(F.col("_n") == 1, PRO).when(F.col("_n") == 2, AGAINST).otherwise("JINAK").alias(name))


def agreement(stance: Column, vote: Column) -> Column:
    """SHODA, NESHODA, or NEHLASOVAL for a vote without a direction."""
    return F.when(~F.coalesce(vote.isin(PRO, AGAINST), F.lit(False)), "NEHLASOVAL").when(vote == stance, "SHODA").otherwise("NESHODA")


def group_tally(votes: DataFrame, ballot: str, group: str, code: str, codes: dict[str, str]) -> DataFrame:
    """Votes of each code by ballot and group; a null group is skipped and an unknown code makes the row but counts nowhere."""
    counts = [F.count_if(F.col(code) == k).alias(name) for name, k in codes.items()]
    out = votes.where(F.col(group).isNotNull()).groupBy(ballot, group).agg(*counts)
    return out.withColumn("total", sum((F.col(n) for n in list(codes)[1:]), F.col(list(codes)[0])))


def single_group_tally(votes: DataFrame, ballots: DataFrame, ballot: str, group: str, code: str, groups: list[str], codes: dict[str, str], rest: str) -> DataFrame:
    """Votes of each listed group in each ballot; unknown codes count as `rest`, a group without votes is null."""
    known = F.col(code).isin([v for k, v in codes.items() if k != rest])
    counts = [F.count_if(F.col(code) == v).alias(k) for k, v in codes.items() if k != rest] + [F.count_if(~F.coalesce(known, F.lit(False))).alias(rest)]
    tally = votes.where(F.col(group).isin(groups)).groupBy(ballot, group).agg(*counts)
    every = ballots.select(ballot).distinct().withColumn(group, F.explode(F.array(*map(F.lit, groups))))
    return every.join(tally, [ballot, group], "left")


def balance(votes: DataFrame, person: str, code: str, pro: str, against: str, abstain: str, excused: str) -> DataFrame:
    """By person: total, pro, against, abstain, absent (any other code), excused among these, and attendance."""
    c = F.col(code)
    absent = ~F.coalesce(c.isin(pro, against, abstain), F.lit(False))
    out = votes.groupBy(person).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(c == pro).alias("pro"), F.count_if(c == against).alias("against"), F.count_if(c == abstain).alias("abstain"),
        F.count_if(absent).alias("absent"), F.count_if(absent & F.col(excused)).alias("excused"),
    )
    return out.withColumn("attendance", F.round((F.col("pro") + F.col("against") + F.col("abstain")) / F.col("total"), 4))


def item_mode(messages: DataFrame, debate: str, item: str, pos: str) -> DataFrame:
    """The most frequent item of each debate (ties: first seen) and its share of all messages."""
    counts = messages.groupBy(debate, item).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    best = F.max_by(F.struct(item, "n"), F.when(F.col(item).isNotNull(), F.struct("n", (-F.col("first")).alias("seen"))))
    out = counts.groupBy(debate).agg(best.alias("b"), F.sum("n").alias("messages"))
    return out.select(debate, F.col(f"b.{item}").alias(item), F.col("b.n").alias("n"), "messages", F.round(F.col("b.n") / F.col("messages"), 3).alias("share"))


def submitted_bills(bills: DataFrame, submitters: DataFrame, bill: str, person: str, single: str) -> DataFrame:
    """Bills by person: the distinct submitters of a bill, or its single person where there are none."""
    group = submitters.where(F.col(person).isNotNull()).groupBy(bill).agg(F.collect_set(person).alias("group"))
    one = F.when(F.col(single).isNotNull(), F.array(F.col(single)))
    return bills.join(group, bill, "left").select(F.explode(F.coalesce("group", one)).alias(person)).groupBy(person).agg(F.count(F.lit(1)).alias("bills"))


def reconcile(votes: DataFrame, declared: DataFrame, ballot: str, value: str, counted: str = "counted") -> DataFrame:
    """Ballot and value pairs whose counted votes differ from the declared number (columns ballot, value, declared).

    Either side may miss a pair; a missing count is 0 and a missing declaration null.
    """
    tally = votes.groupBy(ballot, value).agg(F.count(F.lit(1)).alias(counted))
    out = tally.join(declared.select(ballot, value, "declared"), [ballot, value], "full").withColumn(counted, F.coalesce(counted, F.lit(0)))
    return out.where(~F.col(counted).eqNullSafe(F.col("declared")))


def resolve_vote(asked: DataFrame, votes: DataFrame, bad: DataFrame, ballot: str, person: str, value: str, absent: str, more: list[str] | None = None, ballots: DataFrame | None = None, deputy: str | None = None, excused: str | None = None) -> DataFrame:
    """The vote of a person in a ballot that has no discrepancy, and whether the person was present.

    more are further columns of votes (the club), ballots adds its columns (result, address) by
    ballot, and excused, a flag of asked, counts only with a deputy id.
    """
    usable = asked.join(bad.select(ballot).distinct(), ballot, "left_anti")
    out = usable.join(votes.select(ballot, person, value, *(more or [])), [ballot, person]).withColumn("present", F.col(value) != absent)
    if ballots is not None:
        out = out.join(ballots.dropDuplicates([ballot]), ballot, "left")
    if excused is not None:
        out = out.withColumn(excused, F.coalesce(F.col(excused) & F.col(deputy).isNotNull(), F.lit(False)))
    return out


def votes_by_ballot(votes: DataFrame, ballot: str, name: str, value: str, substantive: str) -> DataFrame:
    """Votes of each ballot sorted by name, and how many of them are substantive or procedural."""
    return votes.groupBy(ballot).agg(
        F.array_sort(F.collect_list(F.struct(name, value))).alias("votes"), F.count_if(F.col(substantive)).alias("substantive"), F.count_if(~F.col(substantive)).alias("procedural")
    )


def ledger(
    messages: DataFrame, ballots: DataFrame, votes: DataFrame, debate: str, item: str, pos: str, ballot: str, person: str, name: str, value: str, codes: list[str], unknown: str,
    chair: str | None = None, deputies: DataFrame | None = None,
) -> DataFrame:
    """Votes of a debate's speakers in the ballots of its item: one row for each debate, ballot and speaker.

    A speaker counts once, under the name first seen; unknown codes become `unknown`. With chair,
    a flag of messages, what the chair says names no speaker; with deputies (a column `person`),
    others are no speakers. Further columns of votes, such as an excused flag, pass.
    """
    item_of = item_mode(messages, debate, item, pos).select(debate, item)
    spoken = messages.where(F.col(person).isNotNull())
    if chair is not None:
        spoken = spoken.where(~F.coalesce(F.col(chair), F.lit(False)))
    speakers = spoken.groupBy(debate, person).agg(F.min_by(name, pos).alias(name))
    more = [c for c in votes.columns if c not in (debate, item, ballot, person, name, value)]
    votes = votes.select(ballot, person, value, *more)
    if deputies is not None:
        speakers, votes = (rows.join(deputies.select(person).distinct(), person, "left_semi") for rows in (speakers, votes))
    seats = saved(item_of.join(speakers, debate), "seats")
    # votes are repeated for the debates of an item in the last join, so that no shuffle moves the repeated rows
    cast = F.when(F.col(value).isin(codes), F.col(value)).otherwise(unknown)
    named = votes.join(ballots.select(item, ballot), ballot).withColumn(value, cast)
    return named.join(seats, [item, person]).select(debate, item, ballot, person, name, value, *more)


def ballot_facts(ballots: DataFrame, tallies: DataFrame, ballot: str, subject: str, result: str, group: str) -> DataFrame:
    """Ballots with kind, whether it is substantive, whether it was passed, and the tallies of its groups as an array."""
    from ..functions.text import classify_ballot

    kind = classify_ballot(F.col(subject))
    nested = tallies.groupBy(ballot).agg(F.array_sort(F.collect_list(F.struct(group, *[c for c in tallies.columns if c not in (ballot, group)]))).alias("groups"))
    told = ballots.withColumn("kind", kind["kind"]).withColumn("substantive", kind["substantive"]).withColumn("passed", F.col(result) == "A")
    return told.join(nested, ballot, "left")


def of_debates(ballots: DataFrame, messages: DataFrame, debate: str, item: str, pos: str) -> DataFrame:
    """Ballots, with all their columns, once for each debate on their item; nothing repeated is shuffled."""
    return ballots.join(saved(item_mode(messages, debate, item, pos).select(debate, item), "debates"), item)


def ledger_ballots(messages: DataFrame, ballots: DataFrame, tallies: DataFrame, debate: str, item: str, pos: str, ballot: str, subject: str, result: str, group: str) -> DataFrame:
    """The ballots of each debate's item: kind, whether it is substantive, whether it was passed, and the tallies of its groups as an array."""
    return of_debates(ballot_facts(ballots, tallies, ballot, subject, result, group), messages, debate, item, pos)


def role_at(probes: DataFrame, member: Column, side: Column) -> DataFrame:
    """MINISTR for a member of a government, else the side of the club at the date, else NEZARAZEN."""
    return probes.withColumn("role_at", F.when(member, "MINISTR").otherwise(F.coalesce(side, F.lit("NEZARAZEN"))))


def side_flip(before: Column, after: Column, sides: list[str], since: Column, start: Column) -> Column:
    """Both roles stand on known sides, these differ, and the date is not before the start."""
    return F.coalesce(before.isin(sides) & after.isin(sides) & (before != after) & (since >= start), F.lit(False))


def first_by(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def to_facts(rows: DataFrame, predicate: str, subject: Column, obj: Column, literal: Column, since: Column, until: Column) -> DataFrame:
    """Facts with a key of predicate, subject, object and start (a dash where null)."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    key = F.concat_ws(":", F.lit(predicate), subject.cast("string"), text(obj), text(since))
    return rows.select(
        key.alias("fact_id"), F.lit(predicate).alias("predicate"), subject.cast("string").alias("subject"), obj.cast("string").alias("object"),
        literal.cast("string").alias("literal"), since.alias("valid_from"), until.alias("valid_to"),
    )


def vote_gold_cases(messages: DataFrame, ballots: DataFrame, key: list[str], ballot: str, said: Column, did: Column, kind: Column) -> DataFrame:
    """One row for each message and ballot that it names: key, ballot, kind, said, did and reason, why they can or cannot be compared.

    messages may name a ballot several times; a ballot without a row in ballots goes.
    """
    from ..functions.score import mismatch_reason

    joined = messages.dropDuplicates([*key, ballot]).join(ballots.dropDuplicates([ballot]), ballot)
    cases = joined.select(*key, ballot, kind.alias("kind"), said.alias("said"), did.alias("did"))
    return cases.withColumn("reason", mismatch_reason(F.col("kind"), F.col("said"), F.col("did")))
