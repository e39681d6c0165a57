"""Chat messages without quotations, ordered by what they reply to.

Only DataFrame functions are used. A passage is a run of lines of one quote level without a
blank one; its lines are joined by blanks, so that it does not matter how it was wrapped.
Passages and their single lines are compared by hash; the original of a hash is the first
message of the conversation that says it, one row for each distinct hash, so that a line which
a third of all messages repeat costs one row a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

_PREFIX = r"^[ \t]*((?:>[ \t]*)+)"


def parsed_lines(text: Column) -> Column:
    """Array of each line's quote level (0: own) and what it says, normalised."""

    def parse(line: Column) -> Column:
        level = F.length(F.regexp_replace(F.regexp_extract(line, _PREFIX, 1), r"[ \t]", ""))
        says = F.when(level > 0, F.regexp_replace(line, _PREFIX, "")).otherwise(line)
        return F.struct(level.alias("level"), F.trim(F.regexp_replace(F.lower(says), r"[\x20\x09\x0B-\x0D]+", " ")).alias("plain"))

    return F.transform(F.split(text, "\n", -1), parse)


def units(text: Column) -> Column:
    """Array of passages and, where a passage has several lines, of its lines: start (its passage's place), level, pos, n (lines), whole, h."""

    def of_lines(lines: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(lines) - 1)
        level, plain = (lambda i: F.get(lines, i)["level"]), (lambda i: F.get(lines, i)["plain"])
        edge = lambda i, j: (plain(i) != "") & (F.coalesce(plain(j), F.lit("")).eqNullSafe("") | (level(i) != level(j)))
        ends = F.arrays_zip(F.filter(at, lambda i: edge(i, i - 1)).alias("a"), F.filter(at, lambda i: edge(i, i + 1)).alias("b"))

        def of_passage(z: Column) -> Column:
            a, n = z["a"], z["b"] - z["a"] + 1
            own = F.slice(lines, a + 1, n)
            unit = lambda pos, size, whole, h: F.struct(a.alias("start"), level(a).alias("level"), pos.alias("pos"), size.alias("n"), F.lit(whole).alias("whole"), h.alias("h"))
            whole = unit(a, n, True, F.xxhash64(F.array_join(F.transform(own, lambda x: x["plain"]), " ")))
            each = F.transform(own, lambda x, i: unit(a + i, F.lit(1), False, F.xxhash64(x["plain"])))
            return F.concat(F.array(whole), F.filter(each, lambda _: n > 1))

        return F.flatten(F.transform(ends, of_passage))

    # the lines are parsed once: an array of one, whose element is bound by the lambda
    return F.transform(F.array(parsed_lines(text)), of_lines)[0]


def reply_order(messages: DataFrame, scratch: Scratch | None = None, max_rounds: int = 40) -> DataFrame:
    """One row for each row of messages: conv_id, turn, role, reply_to, thread, n_quoted, n_linked, n_levels, body.

    messages needs conv_id, turn (integers), role and text. A line that begins with n marks ">"
    is quoted at level n. A quoted passage is linked to the first message of the conversation
    that has it as a passage or a line of its own, if that is an earlier turn; where it is not,
    each of its lines is linked in the same way. n_quoted and n_linked count lines. reply_to is the
    turn that most linked lines of the outermost linked level come from (ties: the later
    turn), null without links. thread is the turn that the chain of reply_to starts from, and
    body the own lines. Rows come in the order conv_id, thread, turn, over range partitions, so
    that each message stands after what it replies to and a long conversation is spread.

    Null text: body null. Empty text: empty body. Null conv_id or turn: no links, thread is the
    turn. Rows that agree in conv_id and turn are parts of one message for those who quote
    it, and identical rows get identical results. Empty table: no rows. Other columns are not
    read.
    """
    s = scratch or Scratch(messages.sparkSession, "quotes")
    m = messages.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").withColumn("row_key", F.xxhash64("role", "text"))
    own = F.filter(F.split("text", "\n", -1), lambda x: ~F.regexp_like(x, F.lit(_PREFIX)))
    quoted = F.size(F.filter(F.split("text", "\n", -1), lambda x: F.regexp_like(x, F.lit(_PREFIX))))
    parts = m.where("conv_id is not null and turn is not null").select("conv_id", "turn", "row_key", F.inline(units(F.col("text"))))
    quotes = s.save(parts.where("level > 0"))
    asked = quotes.select("conv_id", "h").distinct()
    originals = parts.where("level = 0").join(asked, ["conv_id", "h"], "left_semi").groupBy("conv_id", "h").agg(F.min("turn").alias("original"))
    key = ["conv_id", "turn", "row_key"]
    linked = quotes.join(originals, ["conv_id", "h"]).where("original < turn").select(*key, "start", "level", "pos", "n", "whole", "original").distinct()
    linked = linked.withColumn("best", F.max("whole").over(Window.partitionBy(*key, "start"))).where("whole = best")
    votes = linked.groupBy(*key, "level", "original").agg(F.sum("n").alias("n"))
    replies = s.save(
        votes.groupBy(*key).agg(F.max(F.struct((-F.col("level")).alias("outer"), "n", "original")).alias("best"), F.sum("n").alias("n_linked"), F.count_distinct("level").alias("n_levels"))
        .select(*key, F.col("best.original").alias("reply_to"), "n_linked", "n_levels")
    )

    # the start of each chain, by doubling: each round looks twice as far back
    up = s.save(replies.groupBy("conv_id", "turn").agg(F.max("reply_to").alias("up")))
    for _ in range(max_rounds):
        above = up.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("top"))
        far = s.save(up.join(above, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        up = far.select("conv_id", "turn", "up")
        if not far.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError(f"reply chains did not end in {max_rounds} rounds")
    starts = up.select("conv_id", F.col("turn").alias("reply_to"), F.col("up").alias("start"))
    known = replies.join(starts, ["conv_id", "reply_to"], "left").withColumn("start", F.coalesce("start", "reply_to"))
    out = m.select(*key, "role", F.array_join(own, "\n").alias("body"), F.when(F.col("text").isNull(), F.lit(0)).otherwise(quoted).cast("bigint").alias("n_quoted")).join(known, key, "left")
    out = out.select(
        "conv_id", "turn", "role", "reply_to", F.coalesce("start", "turn").alias("thread"), "n_quoted",
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("n_levels", F.lit(0)).alias("n_levels"), "body",
    )
    order = ["conv_id", "thread", "turn"]
    return out.repartitionByRange(*order).sortWithinPartitions(*order)


#: The same rows in SQL.
SQL = r"""
with recursive m as (select row_number() over () as rid, conv_id, turn, role, text from conversations),
l as (select rid, conv_id, turn, pos, line, len(regexp_replace(regexp_extract(line, '^[ \t]*((?:>[ \t]*)+)', 1), '[ \t]', '', 'g')) as level
      from (select rid, conv_id, turn, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as pos from m)),
p as (select *, pos - row_number() over (partition by rid, level order by pos) as g from (select rid, conv_id, turn, pos, level,
      trim(regexp_replace(lower(case when level > 0 then regexp_replace(line, '^[ \t]*((?:>[ \t]*)+)', '') else line end), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) as plain from l) where plain <> ''),
w as (select rid, conv_id, turn, level, g, count(*) as n, string_agg(plain, ' ' order by pos) as plain from p group by all),
i as (select rid, conv_id, turn, level, g, n, true as whole, plain from w union all select rid, p.conv_id, p.turn, level, g, 1, false, p.plain from p join w using (rid, level, g) where w.n > 1),
o as (select conv_id, plain, min(turn) as original from i where level = 0 and turn is not null group by conv_id, plain),
k as (select rid, i.conv_id, turn, level, n, original from i join o using (conv_id, plain) where level > 0 and original < turn qualify whole = bool_or(whole) over (partition by rid, level, g)),
v as (select rid, conv_id, turn, level, original, sum(n) as n from k group by all),
r as (select rid, conv_id, turn, arg_max(original, struct_pack(a := -level, b := n, c := original)) as reply_to, sum(n)::bigint as n_linked, count(distinct level) as n_levels from v group by rid, conv_id, turn),
u as (select conv_id, turn, max(reply_to) as up from r group by conv_id, turn),
c as (select rid, conv_id, reply_to as place from r union all select c.rid, c.conv_id, u.up from c join u on u.conv_id = c.conv_id and u.turn = c.place),
s as (select rid, min(place) as start from c group by rid)
select m.conv_id, m.turn, m.role, r.reply_to, coalesce(s.start, m.turn) as thread,
  coalesce(len(list_filter(string_split(m.text, chr(10)), lambda x: regexp_matches(x, '^[ \t]*>'))), 0)::bigint as n_quoted,
  coalesce(r.n_linked, 0) as n_linked, coalesce(r.n_levels, 0) as n_levels,
  array_to_string(list_filter(string_split(m.text, chr(10)), lambda x: not regexp_matches(x, '^[ \t]*>')), chr(10)) as body
from m left join r using (rid) left join s using (rid)
"""
