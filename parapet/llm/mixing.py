"""Mixing sources to target weights by Poisson replication.

Every document is repeated k times, k drawn from a Poisson distribution whose mean is its source's target repetition
rate. The draw inverts the distribution at a number in (0, 1) made from a seed and the document's key, so that a rerun
gives the same copies. No count of a source's rows is needed beyond one grouped aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SEED = 17
TEMPERATURE = 0.5
#: Hexadecimal digits of an md5 that make the number in (0, 1): 52 bits, all exact in a double.
DIGITS = 13
#: Parts that the rows of one document id spread over.
SALTS = 256


def unit(*parts: Column) -> Column:
    """A number in (0, 1) from the md5 of the parts joined by a bar."""
    key = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return (F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("double") + 0.5) / F.lit(float(16 ** DIGITS))


def rates(docs: DataFrame, source: str = "source", weights: dict[str, float] | None = None,
          temperature: float = TEMPERATURE, scale: float = 1.0) -> DataFrame:
    """One row per source: ``mix_source, n_docs, rate``.

    ``weights`` are target shares by source (others get none); without them a source's share goes with its number of
    documents to the power ``temperature``. The mix has ``scale`` times as many documents as the input, on average.
    Null sources are a source of their own (empty string).
    """
    counts = docs.groupBy(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("mix_source")).agg(
        F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        share = F.pow(F.col("n_docs").cast("double"), F.lit(float(temperature)))
    else:
        pairs = [x for name, w in sorted(weights.items()) for x in (F.lit(name), F.lit(float(w)))]
        share = F.coalesce(F.create_map(*pairs)[F.col("mix_source")], F.lit(0.0)) if pairs else F.lit(0.0)
    shares = counts.withColumn("share", share)
    totals = shares.agg(F.sum("n_docs").alias("docs"), F.sum("share").alias("shares")).first()
    if not totals["shares"]:
        return shares.select("mix_source", "n_docs", F.lit(0.0).alias("rate"))
    rate = F.col("share") / F.lit(totals["shares"]) * F.lit(totals["docs"] * float(scale)) / F.col("n_docs")
    return shares.select("mix_source", "n_docs", rate.alias("rate"))


def steps(rate: Column) -> Column:
    """The distribution function of a Poisson variable at 0, 1, 2, ... until nothing is left above it in a double."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.lit(0.0).alias("log_factorial"), F.lit(0.0).alias("sum"),
                     F.array().cast("array<double>").alias("steps"))

    def add(state, k):
        factorial = state["log_factorial"] + F.when(k > 0, F.log(F.greatest(k, F.lit(1)).cast("double"))).otherwise(0.0)
        total = state["sum"] + F.exp(k * F.log(rate) - rate - factorial)
        return F.struct(factorial.alias("log_factorial"), total.alias("sum"),
                        F.concat(state["steps"], F.array(total)).alias("steps"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(0), last), start, add, lambda s: s["steps"])).otherwise(
        F.array(F.lit(2.0)))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", weights: dict[str, float] | None = None,
        temperature: float = TEMPERATURE, scale: float = 1.0, seed: int = SEED) -> DataFrame:
    """The mixed corpus: all columns of ``docs`` with ``mix_copy`` (from 1) and ``mix_order``, shuffled over the cluster.

    Documents whose draw is 0 are left out; that is how a source with more than its share shrinks. The draw depends on
    seed, document id and source alone: equal rows get equal counts, and rows without id share one draw per source.
    Copies go to partitions by ``mix_order`` (a number from seed, id and copy) and a salt of the row, so that rows of one id
    spread too, and lie in that order within each.
    Empty tables give empty tables. Columns of the same names as the two new ones are replaced.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("mix_copy", "mix_order")]
    table = rates(docs, source, weights, temperature, scale).select("mix_source", steps(F.col("rate")).alias("steps"))
    key = F.coalesce(F.col(source).cast("string"), F.lit(""))
    # the document travels as one value, so that its columns cannot clash with those the draw needs
    held = docs.select(F.struct(*kept).alias("doc"), key.alias("mix_source"), unit(F.lit(seed), F.col(doc_id), key).alias("draw"),
                       F.col(doc_id).alias("id"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt"))
    counted = held.join(table, "mix_source").withColumn("n", F.size(F.filter("steps", lambda c: c < F.col("draw")))).filter("n > 0")
    copies = counted.select("doc", "id", "salt", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n").cast("long"))).alias("mix_copy"))
    ordered = copies.withColumn("mix_order", unit(F.lit(seed + 1), F.col("id"), F.col("mix_copy")))
    # rows of one id share their order; the salt keeps them from sharing a partition
    dealt = ordered.repartition("mix_order", "salt").sortWithinPartitions("mix_order")
    return dealt.select("doc.*", "mix_copy", "mix_order")


#: The same rows from DuckDB; ``{docs}`` is the table.
SQL = f"""
WITH counts AS (SELECT coalesce(source, '') AS s, count(*) AS n, pow(count(*)::DOUBLE, {TEMPERATURE}) AS share
                FROM {{docs}} GROUP BY 1),
rates AS (SELECT s, share / sum(share) OVER () * sum(n) OVER ()::DOUBLE / n AS rate FROM counts),
mass AS (SELECT s, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
         FROM rates, LATERAL (SELECT unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k)),
steps AS (SELECT s, list(c) AS steps FROM (
    SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM mass) GROUP BY s),
draws AS (SELECT d.*, coalesce(source, '') AS s,
    (('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || coalesce(source, '')), 1, {DIGITS}))::BIGINT
     + 0.5) / {16 ** DIGITS}::DOUBLE AS u FROM {{docs}} d),
drawn AS (SELECT draws.* EXCLUDE (s), len(list_filter(steps, lambda c: c < u)) AS times FROM draws JOIN steps USING (s))
"""
#: Follows ``SQL``; ``{columns}`` are the columns wanted.
COPIES = f"""
SELECT {{columns}} FROM (
    SELECT drawn.*, mix_copy,
        (('0x' || substr(md5('{SEED + 1}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || mix_copy), 1, {DIGITS}))::BIGINT
         + 0.5) / {16 ** DIGITS}::DOUBLE AS mix_order
    FROM drawn, LATERAL (SELECT unnest(range(1, times + 1)) AS mix_copy))
"""
