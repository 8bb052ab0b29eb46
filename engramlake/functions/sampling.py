"""A sample of bounded size for fitting a model."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_sample(df: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most `most` rows, by a hash of `keys`, the same ones whatever the order of rows. All rows if there are no more.

    Rows are thinned out by their hash first, so that no task hands on more than its share of the sample.
    """
    n = df.count()
    h = F.xxhash64(*keys)
    if n <= most:
        return df
    kept = int(1.3 * most / n * 1_000_000) + 1
    return df.where(F.pmod(h, F.lit(1_000_000)) < kept).orderBy(h, *keys).limit(most)
