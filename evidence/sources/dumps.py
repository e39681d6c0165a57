"""The typed dumps of sittings and votes, out of raw pipe-delimited rows.

Each raw table has cols (an array of texts) and seq (their order). Only one term's rows are
kept: sessions, turns, ballots and excuses by their organ, the others by the rows of their
parent dump.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places of the columns, and how many columns a row needs at least. A name with ! is
#: an integer that a row must have, with ? an integer or null, with 0 an integer where empty is 0,
#: with - a text where empty is null, with + a text that may be left out.
LAYOUTS: dict[str, tuple[int, dict[str, int]]] = {
    "sessions": (3, {"session_id": 0, "organ": 1, "session!": 2}),
    "agenda": (6, {"item_id": 0, "session_id": 1, "bill_id-": 2, "item?": 4, "title": 5, "bill_ref+": 6}),
    "turns": (4, {"turn_id": 0, "organ": 1, "session!": 2, "turn!": 3}),
    "records": (4, {"turn_id": 0, "person": 1, "anchor!": 2, "item_id": 3, "kind~": 4}),
    "ballots": (15, {
        "ballot": 0, "organ": 1, "session!": 2, "number!": 3, "item0": 4, "date": 5, "time": 6, "pro!": 7, "against!": 8,
        "abstained!": 9, "not_voted!": 10, "present!": 11, "quorum!": 12, "result": 14, "title+": 15,
    }),
    "votes": (3, {"deputy": 0, "ballot": 1, "code": 2}),
    "annulled": (1, {"ballot": 0}),
    "excuses": (5, {"organ": 0, "deputy": 1, "date": 2, "since": 3, "until": 4}),
}


def typed(raw: DataFrame, layout: tuple[int, dict[str, int]]) -> DataFrame:
    """Rows of one dump with named columns and seq; short rows and rows without a required integer go."""
    least, places = layout
    columns, valid = [], F.size("cols") >= least
    for name, place in places.items():
        text = F.get("cols", F.lit(place))
        value: Column = {
            "!": text.try_cast("bigint"), "?": text.try_cast("bigint"), "0": F.when(text == "", 0).otherwise(text.try_cast("bigint")),
            "-": F.when(text != "", text), "+": F.coalesce(text, F.lit("")), "~": text,
        }.get(name[-1], text)
        if name[-1] in "!0":
            valid = valid & value.isNotNull()
        columns.append(value.alias(name.rstrip("!?0-+~")))
    return raw.where(valid).select("seq", *columns)


def last_by(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key by seq."""
    rest = [c for c in rows.columns if c not in (key, "seq")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("r")).select(key, "r.*")


def parse_vote_dumps(raw: dict[str, DataFrame], term: str) -> dict[str, DataFrame]:
    """The eight tables of a term, by the names of LAYOUTS; raw has a table for each name.

    Of sessions and turns with one id the last row stays. A record takes organ, session and turn
    of its turn; records without an item, or with item "0", go. Nulls in cols count as missing.
    """
    t = {name: typed(raw[name], layout) for name, layout in LAYOUTS.items()}
    own = lambda name: t[name].where(F.col("organ") == term)
    sessions, turns, ballots = last_by(own("sessions"), "session_id"), last_by(own("turns"), "turn_id"), own("ballots").drop("seq")
    known = ballots.select("ballot").distinct()
    return {
        "sessions": sessions,
        "agenda": t["agenda"].drop("seq").join(sessions.select("session_id"), "session_id", "left_semi"),
        "turns": turns,
        "records": t["records"].where("item_id not in ('', '0')").join(turns, "turn_id").drop("turn_id"),
        "ballots": ballots,
        "votes": t["votes"].drop("seq").join(known, "ballot", "left_semi"),
        "annulled": t["annulled"].select("ballot").distinct().join(known, "ballot", "left_semi"),
        "excuses": own("excuses").drop("seq"),
    }
