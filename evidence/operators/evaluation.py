"""Pairs with what is known about them, what is still to do, and how results compare with labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_filter(rows: DataFrame, score: Column, similarity: Column, low: float, high: float, least_similarity: float, name: str = "band") -> DataFrame:
    """Rows similar enough with a score from `low` on: "tribunal" from `high` on, else "lead"; null scores go."""
    return rows.where((score >= low) & (similarity >= least_similarity)).withColumn(name, F.when(score >= high, "tribunal").otherwise("lead"))


def pair_enrich(pairs: DataFrame, *levels: tuple[DataFrame, str, str]) -> DataFrame:
    """Pairs joined with each level in turn: (table, column of what is there, key of the table). Pairs without a match go.

    The key columns of a level must be new names; the tables are unique on them.
    """
    for table, at, key in levels:
        pairs = pairs.join(table, F.col(at) == F.col(key))
    return pairs


def verdict_left_join(rows: DataFrame, verdicts: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """All rows with their verdict or nulls; of several verdicts of a key the last by order."""
    if order is not None:
        rest = [c for c in verdicts.columns if c not in key]
        verdicts = verdicts.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("_v")).select(*key, "_v.*")
    return rows.join(verdicts, key, "left")


def pending(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key was not done; rows with a null in the key are always pending."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")


def precision_recall(rows: DataFrame, expected: Column, got: Column, by: list[str] | None = None, digits: int = 6) -> DataFrame:
    """Hits, false hits and misses with precision and recall, null where nothing was got or expected; a null flag is false."""
    e, g = F.coalesce(expected, F.lit(False)), F.coalesce(got, F.lit(False))
    k = rows.groupBy(*(by or [])).agg(F.count_if(e & g).alias("tp"), F.count_if(~e & g).alias("fp"), F.count_if(e & ~g).alias("fn"))
    ratio = lambda rest: F.round(F.try_divide("tp", F.col("tp") + F.col(rest)), digits)
    return k.withColumn("prec", ratio("fp")).withColumn("recall", ratio("fn"))


def confusion_matrix(rows: DataFrame, expected: str, predicted: str, labels: dict, digits: int = 6) -> DataFrame:
    """One row for each expected label: a count for each predicted one (labels: value to column name), its recall, and the accuracy of all.

    Only the listed predicted labels count; without a row of a pair the count is null.
    """
    m = rows.groupBy(expected).pivot(predicted, list(labels)).count().withColumnsRenamed({str(k): v for k, v in labels.items()})
    n = {k: F.coalesce(v, F.lit(0)) for k, v in labels.items()}
    total = sum(n.values(), F.lit(0))
    right = sum((F.when(F.col(expected) == k, c).otherwise(0) for k, c in n.items()), F.lit(0))
    whole = m.agg(F.round(F.try_divide(F.sum(right), F.sum(total)), digits).alias("accuracy"))  # one row
    return m.withColumn("recall", F.round(F.try_divide(right, total), digits)).crossJoin(F.broadcast(whole))


def text_stats(rows: DataFrame, by: str, text: str, source: str) -> DataFrame:
    """Documents, characters and distinct sources of each group."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length(text)).alias("characters"), F.count_distinct(source).alias("sources"))


def provenance_count(rows: DataFrame, engine: Column) -> DataFrame:
    """How many rows the engine and how many hands made."""
    return rows.groupBy(F.when(engine, "engine").otherwise("hand").alias("producer")).agg(F.count(F.lit(1)).alias("n"))


def annotation_stats(rows: DataFrame, by: str, score: Column, publish: float, context: float, digits: int = 4) -> DataFrame:
    """Rows of each group by what their score allows, and the mean score of those not rejected; null scores count in n only."""
    return rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(score >= publish).alias("published"), F.count_if((score >= context) & (score < publish)).alias("context"),
        F.count_if(score < context).alias("rejected"), F.round(F.avg(F.when(score >= context, score)), digits).alias("mean_confidence"),
    )


def facts_for_subject(facts: DataFrame, asked: DataFrame | None = None, predicate: str | None = None) -> DataFrame:
    """Facts of the asked subjects (all without a table of them), of one predicate if given."""
    found = facts if predicate is None else facts.where(F.col("predicate") == predicate)
    return found if asked is None else found.join(asked.select("subject").distinct(), "subject", "left_semi")


def count_facts(facts: DataFrame) -> DataFrame:
    """Number of facts and first start of each subject."""
    return facts.groupBy("subject").agg(F.count(F.lit(1)).alias("facts"), F.min("valid_from").alias("first_from"))


def entity_union(*parts: tuple[DataFrame, str], name: str = "k") -> DataFrame:
    """The distinct values of a column of each table."""
    out = None
    for df, column in parts:
        one = df.select(F.col(column).alias(name))
        out = one if out is None else out.union(one)
    return out.distinct()
