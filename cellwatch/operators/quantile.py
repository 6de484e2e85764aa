"""Exact percentiles of groups too large for one task's memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


SALTS = 32


def exact_group_percentile(
    df: DataFrame,
    keys: list[str],
    value: str,
    q: float,
    out: str,
    accuracy: int = 10_000,
    few_groups: bool = False,
) -> DataFrame:
    """Linear-interpolated percentile `q` per group, exact at any group size.

    A sketch brackets the wanted order statistic within a known rank error;
    values below the bracket are only counted and values above it dropped. The
    ordered step sees at most 8/accuracy of a group (all of it up to `accuracy`
    rows). Equal values combine before the shuffle.

    Brackets reach the rows by broadcast when the caller knows the groups to be
    few (dates, hours), else by a join salted over `SALTS`, so that a group
    holding a large share of the rows is spread over many tasks.
    """
    values = df.select(*keys, value).where(F.col(value).isNotNull())
    margin = 4.0 / accuracy
    brackets = values.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.percentile_approx(value, [max(0.0, q - margin), min(1.0, q + margin)], accuracy).alias("_b"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
    )
    small = F.col("_n") <= accuracy
    brackets = brackets.select(
        *keys,
        "_n",
        F.when(small | F.lit(q < margin), F.col("_min")).otherwise(F.col("_b")[0]).alias("_lo"),
        F.when(small | F.lit(q > 1 - margin), F.col("_max")).otherwise(F.col("_b")[1]).alias("_hi"),
    )
    if few_groups:
        matched = values.join(F.broadcast(brackets), keys)
    else:
        salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))
        salted = values.withColumn("_salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        matched = salted.join(brackets.withColumn("_salt", salts), [*keys, "_salt"])
    steps = (
        matched.where(F.col(value) <= F.col("_hi"))
        .groupBy(*keys, "_n", F.when(F.col(value) >= F.col("_lo"), F.col(value)).alias("_v"))
        .agg(F.count("*").alias("_c"))
        .withColumn(
            "_upto",
            F.sum("_c").over(
                W.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")).rowsBetween(W.unboundedPreceding, 0)
            ),
        )
    )
    place = F.lit(q) * (F.col("_n") - 1)
    at_low = F.min(F.when(F.col("_upto") > F.floor(place), F.col("_v")))
    at_high = F.min(F.when(F.col("_upto") > F.ceil(place), F.col("_v")))
    below = F.coalesce(F.max(F.when(F.col("_v").isNull(), F.col("_upto"))), F.lit(0))
    found = F.col("_low") + (F.col("_high") - F.col("_low")) * (place - F.floor(place))
    # A sketch worse than its bound would move the place out of the bracket: never without a word.
    missed = (F.col("_below") > F.floor(place)) | (F.col("_seen") <= F.ceil(place))
    return (
        steps.groupBy(*keys, "_n")
        .agg(at_low.alias("_low"), at_high.alias("_high"), below.alias("_below"), F.max("_upto").alias("_seen"))
        .select(*keys, F.when(missed, F.raise_error(F.lit("percentile outside its bracket"))).otherwise(found).alias(out))
    )
