"""Joins whose keys may be hot."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets of keys that are counted; a bucket is heavy from so many times the mean on, and from so many rows on.
BUCKETS, TIMES_MEAN, LEAST_ROWS = 4096, 4, 500


def spread_join(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """Joins ``many`` with the one row of ``one`` for each key, with heavy keys dealt over many tasks.

    Rows of ``many`` are counted by buckets of their keys (``counted``: a table
    with the same keys that is cheaper to read).  The rows of a heavy bucket are
    dealt into parts, and the bucket's rows of ``one`` go to each part.  At most a
    quarter of the buckets can hold four times the mean, so the list of heavy
    ones is bounded, and so is what is repeated: parts times the other keys of a
    bucket, about the rows of ``many`` there.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    sizes = {r["bucket"]: r["count"] for r in (counted or many).groupBy(bucket.alias("bucket")).count().collect()}
    limit = max(LEAST_ROWS, TIMES_MEAN * sum(sizes.values()) / BUCKETS)
    heavy = [(b, math.ceil(n / limit)) for b, n in sizes.items() if n > limit]
    if not heavy:
        return many.join(one.hint("merge"), keys, how)
    parts = many.sparkSession.createDataFrame(heavy, "spread_bucket long, spread_parts int")

    def sized(df: DataFrame) -> DataFrame:
        found = df.withColumn("spread_bucket", bucket).join(F.broadcast(parts), "spread_bucket", "left")
        return found.withColumn("spread_parts", F.coalesce("spread_parts", F.lit(1)))

    dealt = sized(many).withColumn("spread_part", F.pmod(F.monotonically_increasing_id(), F.col("spread_parts")).cast("int"))
    repeated = sized(one).withColumn("spread_part", F.explode(F.sequence(F.lit(0), F.col("spread_parts") - 1)))
    own = ["spread_bucket", "spread_parts"]
    return dealt.drop(*own).join(repeated.drop(*own).hint("merge"), [*keys, "spread_part"], how).drop("spread_part")
