"""Pairs and scores bound to embeddings, lineitem, labels and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import score as S
from ..operators import evaluation as E
from ..operators import pairs as P
from ..sources.files import saved
from .registry import Tables, query

TOP_SQL = """c as (select vec_id, label, embedding::double[] as v, case when vec_id % 5 <> 0 then 2020 + vec_id % 3 end as year from embeddings),
  p as (select a.label, a.vec_id, b.vec_id as other, list_dot_product(a.v, b.v) as s, coalesce(a.year <> b.year, false) as conflict from c a join c b on a.label = b.label and a.vec_id <> b.vec_id),
  q as (select *, case when conflict then greatest(0.0, s - 0.10) else s end as score from p),
  r as (select label, vec_id, other, round(score, 6) as score, conflict, row_number() over (partition by vec_id order by round(score, 9) desc, other) as rank from q)"""


def _top(t: Tables) -> DataFrame:
    year = F.when(F.col("vec_id") % 5 != 0, 2020 + F.col("vec_id") % 3)
    claims = t.embeddings.select("vec_id", "label", "embedding", year.alias("year"))
    return P.topk_similar(claims, "label", "vec_id", "embedding", "year")


@query(f"with {TOP_SQL} select label, vec_id, other, score, conflict, rank::integer as rank from r where rank <= 5")
def topk_similar(t: Tables) -> DataFrame:
    return _top(t).withColumn("score", F.round("score", 6))


@query(f"with {TOP_SQL} select label, count(*) as pairs, round(avg(score), 4) as mean_score from r where rank <= 5 group by label")
def candidate_pair_join(t: Tables) -> DataFrame:
    return _top(t).withColumn("score", F.round("score", 6)).groupBy("label").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("score"), 4).alias("mean_score"))


@query(f"""with {TOP_SQL}, d as (select *, row_number() over (partition by least(vec_id, other), greatest(vec_id, other) order by label, vec_id, rank) as n from r where rank <= 5)
  select vec_id, other, score from d where n = 1""")
def pair_dedupe(t: Tables) -> DataFrame:
    d = P.pair_dedupe(_top(t), "vec_id", "other", [F.col("label"), F.col("vec_id"), F.col("rank")])
    return d.select("vec_id", "other", F.round("score", 6).alias("score"))


@query(f"""with {TOP_SQL}, e as (select vec_id, max(other) as expected from r where rank <= 3 and vec_id % 2 = 0 group by vec_id
    union all select vec_id, -1 from c where vec_id % 50 = 1)
  select (select count(*) from e) as queries, (select count(*) from e where exists(select 1 from r where rank <= 5 and r.vec_id = e.vec_id and r.other = e.expected)) as hits, (select count(*) from r join c on c.vec_id = r.other where rank <= 5 and c.label <> r.label) as leaks,
    round((select count(*) from e where exists(select 1 from r where rank <= 5 and r.vec_id = e.vec_id and r.other = e.expected)) / (select count(*) from e), 6) as recall""")
def recall_at_k(t: Tables) -> DataFrame:
    top = saved(_top(t), "top")  # read three times
    e = top.where("rank <= 3 and vec_id % 2 = 0").groupBy("vec_id").agg(F.max("other").alias("expected"))
    e = e.union(t.embeddings.where("vec_id % 50 = 1").select("vec_id", F.lit(-1).cast("bigint")))
    return P.recall_at_k(top, e, "vec_id", "label", t.embeddings)


@query("""with l as (select label, vec_id, embedding::double[] as v, (vec_id * 37 % 300) / 10.0 as len from embeddings where vec_id % 20 > 2),
    g as (select label, arg_max(v, struct_pack(a := len, b := -vec_id)) as v, max(len) as len from l group by label), f as (select vec_id as ref, embedding::double[] as r from embeddings where vec_id % 20 <= 2),
    s as (select label, least(20.0, len)::double as clip, ref, list_cosine_similarity(v, r) as c from g cross join f where len >= 1)
  select label, clip, ref, round(c, 6) as cosine, rank from (select *, row_number() over (partition by label order by round(c, 9) desc, ref)::integer as rank from s) where rank <= 3""")
def nearest_reference(t: Tables) -> DataFrame:
    e = t.embeddings.withColumn("len", (F.col("vec_id") * 37 % 300) / 10.0)
    out = P.nearest_reference(e.where("vec_id % 20 > 2"), e.where("vec_id % 20 <= 2"), "label", "len", "vec_id", "embedding", "vec_id")
    return out.withColumn("cosine", F.round("cosine", 6))


@query("""with v as (select doc_id, len(coalesce(text, ''))::double as a, (len(coalesce(text, '')) - len(replace(coalesce(text, ''), 'e', '')))::double as b, 3.0::double as c from documents)
  select doc_id, round(a / sqrt(a * a + b * b + c * c), 6) as length, round(b / sqrt(a * a + b * b + c * c), 6) as letters, round(c / sqrt(a * a + b * b + c * c), 6) as rest from v""")
def embed_texts(t: Tables) -> DataFrame:
    """Documents with a unit vector of an encoder that counts letters."""
    out = P.embed_texts(t.documents.select("doc_id", "text"), lambda texts: [[float(len(x)), float(x.count("e")), 3.0] for x in texts], "text")
    return out.select("doc_id", *[F.round(F.col("vector")[i], 6).alias(n) for i, n in enumerate(("length", "letters", "rest"))])


@query("""select l_orderkey, l_linenumber, l_suppkey, o_custkey, c_nationkey, n_name from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
  join nation on c_nationkey = n_nationkey""")
def pair_enrich(t: Tables) -> DataFrame:
    j = E.pair_enrich(t.lineitem, (t.orders, "l_orderkey", "o_orderkey"), (t.customer, "o_custkey", "c_custkey"), (t.nation, "c_nationkey", "n_nationkey"))
    return j.select("l_orderkey", "l_linenumber", "l_suppkey", "o_custkey", "c_nationkey", "n_name")


@query("""select o_orderkey, o_orderstatus, n, round(q, 2) as q from orders left join (select l_orderkey, count(*) as n, sum(l_quantity) as q from lineitem group by 1) on l_orderkey = o_orderkey""")
def verdict_left_join(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))
    return E.verdict_left_join(t.orders, lines, ["o_orderkey"]).select("o_orderkey", "o_orderstatus", "n", "q")


@query("""select l_orderkey, l_linenumber, l_suppkey, l_partkey, l_discount * 10 as contradiction, round(1 - l_tax, 2) as sim, case when l_discount * 10 >= 0.8 then 'tribunal' else 'lead' end as band
  from lineitem where l_discount * 10 >= 0.5 and round(1 - l_tax, 2) >= 0.95 and l_returnflag = 'R'""")
def band_filter(t: Tables) -> DataFrame:
    rows = t.lineitem.withColumn("contradiction", F.col("l_discount") * 10).withColumn("sim", F.round(1 - F.col("l_tax"), 2))
    kept = E.band_filter(rows.where("l_returnflag = 'R'"), F.col("contradiction"), F.col("sim"), 0.5, 0.8, 0.95)
    return kept.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "contradiction", "sim", "band")


COMPOSITE_SQL = """s as (select l_orderkey, l_linenumber, l_suppkey, l_partkey, l_discount * 10 as nli, case when l_linenumber = 4 then null else l_tax * 12 end as sim,
    case l_returnflag when 'A' then 1.0 when 'N' then 0.0 end as fact, l_quantity / 50 as tri from lineitem),
  k as (select *, round(greatest(0.0, least(1.0, (0.35 * greatest(0.0, least(1.0, coalesce(nli, 0.5))) + 0.20 * greatest(0.0, least(1.0, coalesce(sim, 0.5)))
    + 0.15 * greatest(0.0, least(1.0, coalesce(fact, 0.5))) + 0.30 * greatest(0.0, least(1.0, coalesce(tri, 0.5)))) / 1.0)), 6) as score from s)"""


def _scored(t: Tables) -> DataFrame:
    fact = F.when(F.col("l_returnflag") == "A", True).when(F.col("l_returnflag") == "N", False)
    score = S.composite_score(S.WEIGHTS, nli=F.col("l_discount") * 10, similarity=F.when(F.col("l_linenumber") != 4, F.col("l_tax") * 12), hard_fact=fact, tribunal=F.col("l_quantity") / 50)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.round(score, 6).alias("score"))


@query(f"with {COMPOSITE_SQL} select l_orderkey, l_linenumber, l_suppkey, l_partkey, score from k")
def composite_score(t: Tables) -> DataFrame:
    return _scored(t)


@query(f"""with {COMPOSITE_SQL} select l_orderkey, l_linenumber, l_suppkey, l_partkey,
  case when score >= 0.95 then 'PUBLISHED' when score >= 0.80 then 'CONTEXT_DEVELOPMENT' else 'DROPPED' end as tier,
  case when score >= 0.95 then 'very high' when score >= 0.85 then 'high' when score >= 0.80 then 'moderate' else 'low' end as band,
  case when score >= 0.95 then 'consistent' when score >= 0.85 then 'mostly consistent' when score >= 0.70 then 'mixed' else 'inconsistent' end as label from k""")
def presentation_tier(t: Tables) -> DataFrame:
    x = F.col("score")
    return _scored(t).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", S.presentation_tier(x).alias("tier"), S.confidence_band(x).alias("band"), S.index_label(x).alias("label"))


@query(f"with {COMPOSITE_SQL} select l_orderkey, l_linenumber, l_suppkey, l_partkey, score from k where score >= 0.80")
def publishable_gate(t: Tables) -> DataFrame:
    return _scored(t).where(S.presentation_tier(F.col("score")) != "DROPPED")


@query(f"""with {COMPOSITE_SQL}, b as (select *, case l_linenumber % 3 when 0 then 'VALUE_SHIFT' when 1 then 'CONTRADICTION' else 'OMISSION' end as kind, l_suppkey % 6 = 0 as dismissed, l_partkey % 2 = 0 as passed,
    case when l_suppkey % 4 = 0 then 'VALUE_SHIFT' end as downgrade, case when l_partkey % 9 = 0 then 0.5 end as override from k)
  select l_orderkey, l_linenumber, l_suppkey, l_partkey, case when downgrade is not null and downgrade <> kind then downgrade else kind end as kind,
    case when downgrade is not null and downgrade <> kind then 'MEDIUM' else 'HIGH' end as severity, coalesce(override, score)::double as score,
    case when downgrade is not null and downgrade <> kind then kind end as downgraded_from from b where not dismissed and (passed or downgrade is not null)""")
def apply_verdict(t: Tables) -> DataFrame:
    kind = F.when(F.col("l_linenumber") % 3 == 0, "VALUE_SHIFT").when(F.col("l_linenumber") % 3 == 1, "CONTRADICTION").otherwise("OMISSION")
    v = S.applied_verdict(F.col("l_suppkey") % 6 == 0, F.col("l_partkey") % 2 == 0, F.when(F.col("l_suppkey") % 4 == 0, "VALUE_SHIFT"), kind, F.lit("HIGH"), F.col("score"), F.when(F.col("l_partkey") % 9 == 0, 0.5))
    return _scored(t).withColumn("v", v).where("v.kept").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "v.kind", "v.severity", "v.score", "v.downgraded_from")


@query("""with p as (select conv_id, turn, len(text) as a, len(lag(text) over (partition by conv_id order by turn)) as b from conversations where text is not null), s as (select *, a / (a + b + 1)::double as e, b / (a + b + 1)::double as n, 1 / (a + b + 1)::double as c from p where b is not null)
  select conv_id, turn, round(e, 6) as entailment, round(n, 6) as neutral, round(c, 6) as contradiction, case greatest(e, n, c) when e then 'ENTAILMENT' when n then 'NEUTRAL' else 'CONTRADICTION' end as relation from s""")
def score_pairs(t: Tables) -> DataFrame:
    """Each message against the one before it, by a scorer that only looks at lengths."""
    prev = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = t.conversations.where("text is not null").select("conv_id", "turn", F.col("text").alias("a"), prev.alias("b")).where("b is not null")

    def scorer(a: list[str], b: list[str]) -> list[tuple[float, float, float]]:
        return [(len(x) / (len(x) + len(y) + 1), len(y) / (len(x) + len(y) + 1), 1 / (len(x) + len(y) + 1)) for x, y in zip(a, b, strict=True)]

    scored = P.score_pairs(pairs, scorer, "a", "b")
    label = S.argmax_label({"ENTAILMENT": F.col("entailment"), "NEUTRAL": F.col("neutral"), "CONTRADICTION": F.col("contradiction")})
    return scored.select("conv_id", "turn", *[F.round(c, 6).alias(c) for c in ("entailment", "neutral", "contradiction")], label.alias("relation"))


@query("""with p as (select l_orderkey * 10 + l_linenumber as id, l_orderkey, l_suppkey, l_extendedprice as s, l_partkey from lineitem),
    b as (select * from (select *, row_number() over (order by s desc, id * 100000 + l_partkey) as n from p) where n <= 100),
    d as (select *, row_number() over (partition by least(l_orderkey, l_suppkey), greatest(l_orderkey, l_suppkey) order by s desc, id * 100000 + l_partkey) as k from b)
  select id, l_orderkey, l_suppkey, s from d where k = 1 order by s desc, id * 100000 + l_partkey limit 60""")
def topn_candidates(t: Tables) -> DataFrame:
    p = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_orderkey", "l_suppkey", F.col("l_extendedprice").alias("s"), "l_partkey")
    p = p.withColumn("tie", F.col("id") * 100000 + F.col("l_partkey"))
    return P.topn_candidates(p, "s", "tie", "l_orderkey", "l_suppkey", 20).select("id", "l_orderkey", "l_suppkey", "s")


@query("""with p as (select * from labels where toxic = 1), n as (select *, row_number() over (order by md5(doc_id || ':42')) as r from labels where not coalesce(toxic = 1, false))
  select doc_id, quality, toxic from p union all select doc_id, quality, toxic from n where r <= greatest(2 * (select count(*) from p), 50)""")
def balanced_sample(t: Tables) -> DataFrame:
    return P.balanced_sample(t.labels, F.coalesce(F.col("toxic") == 1, F.lit(False)), F.col("doc_id"))


@query("""select doc_id from documents where doc_id not in (select doc_id from labels)""")
def pending_anti_join(t: Tables) -> DataFrame:
    return E.pending(t.documents, t.labels, ["doc_id"]).select("doc_id")


@query("""with c as (select l.doc_id, quality = 1 as expected, max(case when n_chars > 3000 then 2 when n_chars > 1500 then 1 else 0 end) as tier from labels l left join documents using (doc_id) group by all),
    k as (select count(*) filter (where expected and tier >= least) as tp, count(*) filter (where not expected and tier >= least) as fp, count(*) filter (where expected and not tier >= least) as fn,
      least as least_tier from c cross join (select unnest([1, 2]) as least) group by least)
  select least_tier, tp, fp, fn, round(case when tp + fp = 0 then null else tp / (tp + fp) end, 6) as prec, round(case when tp + fn = 0 then null else tp / (tp + fn) end, 6) as recall from k""")
def precision_recall(t: Tables) -> DataFrame:
    tier = F.max(F.when(F.col("n_chars") > 3000, 2).when(F.col("n_chars") > 1500, 1).otherwise(0))
    c = t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id", "left").groupBy("doc_id", (F.col("quality") == 1).alias("expected")).agg(tier.alias("tier"))
    c = c.withColumn("least_tier", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn("got", F.col("tier") >= F.col("least_tier"))
    return E.precision_recall(c, F.col("expected"), F.col("got"), ["least_tier"])


@query("""with c as (select quality as expected, toxic as predicted, count(*) as n from labels group by all)
  select expected, sum(n) filter (where predicted = 0)::bigint as p0, sum(n) filter (where predicted = 1)::bigint as p1, round(coalesce(sum(n) filter (where predicted = expected), 0) / sum(n), 6) as recall,
    round((select sum(n) from c where predicted = expected) / (select sum(n) from c), 6) as accuracy from c group by expected""")
def confusion_matrix(t: Tables) -> DataFrame:
    return E.confusion_matrix(t.labels.withColumnRenamed("quality", "expected"), "expected", "toxic", {0: "p0", 1: "p1"})
