"""Seeded name mutations and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.registry import line_names

#: A document whose id is divisible by this gives one query: the stated query set of the searches.
QUERY_EVERY = 20
MUTATIONS = ("missing", "extra", "typo", "transposition", "truncation", "separator")


def mutated(name: str = "name", choice: str = "choice"):
    """One of the mutations of a name, by number."""
    t = F.split(F.col(name), "_")
    first, last, rest = t[0], F.element_at(t, -1), F.slice(t, 2, 100)
    most = F.slice(t, F.lit(1), F.size(t) - 1)
    long = F.length(first) >= 4
    forms = [
        F.concat(F.slice(t, 1, 1), F.slice(t, 3, 100)),
        F.concat(F.slice(t, 1, 1), F.array(F.lit("extra")), rest),
        F.concat(F.array(F.when(long, F.concat(F.substring(first, 1, 1), F.substring(first, 3, 100))).otherwise(first)), rest),
        F.concat(F.array(F.when(long, F.concat(F.substring(first, 1, 1), F.substring(first, 3, 1), F.substring(first, 2, 1), F.substring(first, 4, 100))).otherwise(first)), rest),
        F.concat(most, F.array(F.when(F.length(last) >= 5, F.substring(last, F.lit(1), F.length(last) - 2)).otherwise(last))),
        F.concat(F.array(F.concat(t[0], t[1])), F.slice(t, 3, 100)),
    ]
    out = F.when(F.col(choice) == 0, F.array_join(forms[0], "_"))
    for i, form in enumerate(forms[1:], 1):
        out = out.when(F.col(choice) == i, F.array_join(form, "_"))
    return out


def mutation_cases(docs: DataFrame) -> DataFrame:
    """query_id, mutation, query and expected: the first name of every 20th document, mutated."""
    named = line_names(docs.where(F.col("doc_id") % QUERY_EVERY == 0)).groupBy("doc_id").agg(F.min_by("name", "line").alias("expected"))
    cases = named.withColumn("choice", F.pmod((F.col("doc_id") / QUERY_EVERY).cast("bigint"), F.lit(len(MUTATIONS))))
    kind = F.array(*map(F.lit, MUTATIONS))[F.col("choice").cast("int")]
    return cases.select(F.col("doc_id").alias("query_id"), kind.alias("mutation"), mutated("expected").alias("query"), "expected")


def metrics(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """queries, hit@1, hit@5 and returned, of each mutation and of all, from (query_id, name, rank)."""
    best = cases.join(ranked, "query_id", "left").groupBy("query_id", "mutation", "expected").agg(
        F.min(F.when(F.col("name") == F.col("expected"), F.col("rank"))).alias("place"), F.count("name").alias("n")
    )
    hit = lambda k: F.count(F.when(F.col("place") <= k, 1))
    return (
        best.groupingSets([[F.col("mutation")], []], "mutation")
        .agg(F.count("*").alias("queries"), hit(1).alias("hit_1"), hit(5).alias("hit_5"), F.count(F.when(F.col("n") > 0, 1)).alias("returned"))
        .withColumn("mutation", F.coalesce("mutation", F.lit("all")))
    )


def permuted(names: DataFrame) -> DataFrame:
    """Each name reversed, and rotated by one token."""
    t = F.split("name", "_")
    return names.where(F.size(t) >= 3).select("name", F.array_join(F.reverse(t), "_").alias("reverse"), F.array_join(F.concat(F.slice(t, 2, 100), F.slice(t, 1, 1)), "_").alias("rotate"))


def negative_cases(cases: DataFrame) -> DataFrame:
    """query_id, mutation, query: each expected name with its tokens reversed, and a name that is like none."""
    t = F.split("expected", "_")
    reverse = cases.where(F.size(t) >= 3).select("query_id", F.lit("reverse").alias("mutation"), F.array_join(F.reverse(t), "_").alias("query"))
    return reverse.unionByName(cases.select("query_id", F.lit("unrelated").alias("mutation"), F.concat(F.lit("zzq"), "query_id", F.lit("_xxk_vvw")).alias("query")))


#: Apart from each other are the ids of the queries that are made of one name.
_APART = 1 << 40


def evaluation_cases(cases: DataFrame) -> DataFrame:
    """query_id, split, mutation, query, expected: the mutated names, each name reversed and rotated by a token, and a name that is
    like none. A name's split, calibration or holdout, follows from a hash of it alone, so it stays when names are added."""
    t = F.split("expected", "_")
    long = cases.where(F.size(t) >= 3)
    other = lambda rows, i, mutation, query: rows.select((F.col("query_id") + i * _APART).alias("query_id"), F.lit(mutation).alias("mutation"), query.alias("query"), "expected")
    every = (
        cases.select("query_id", "mutation", "query", "expected")
        .unionByName(other(long, 1, "reverse", F.array_join(F.reverse(t), "_"))).unionByName(other(long, 2, "rotate", F.array_join(F.concat(F.slice(t, 2, 1000), F.slice(t, 1, 1)), "_")))
        .unionByName(other(cases, 3, "unrelated", F.concat(F.lit("zzq"), "query_id", F.lit("_xxk_vvw"))))
    )
    return every.withColumn("split", F.when(F.substring(F.md5("expected"), 1, 1) < "8", "calibration").otherwise("holdout"))


def evaluated(cases: DataFrame, ranked: DataFrame) -> DataFrame:
    """By split and mutation: queries, hit_1, hit_5, returned, and the median and 95th percentile of the best scores.

    ``ranked``: query_id, name, rank, match_score.
    """
    per_query = ranked.join(cases.select("query_id", "expected"), "query_id").groupBy("query_id").agg(F.min(F.when(F.col("name") == F.col("expected"), F.col("rank"))).alias("place"), F.max("match_score").alias("best"))
    rows = cases.select("query_id", "split", "mutation").join(per_query, "query_id", "left")
    hit = lambda k: F.count(F.when(F.col("place") <= k, 1))
    share = lambda p: F.percentile_approx("best", p, 10_000)
    return rows.groupBy("split", "mutation").agg(F.count("*").alias("queries"), hit(1).alias("hit_1"), hit(5).alias("hit_5"), F.count("best").alias("returned"), share(0.5).alias("median_score"), share(0.95).alias("p95_score"))
