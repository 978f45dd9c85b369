"""Repeatable samples and splits, chosen by key hash or by seeded Bernoulli draws."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketscope.functions.hashing import BALANCE, SAMPLE, SIZE, key_fraction

PART_ROWS = 100_000  # rows a task at most
LEAST_PARTS = 16  # of a table with more rows than that


def hash_sample(df: DataFrame, key: str, fraction: float, salt: str = SAMPLE) -> DataFrame:
    """Rows whose key hash lies in the first `fraction` of the range."""
    return df.filter(key_fraction(key, salt) < fraction)


def bernoulli_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Spark's own seeded sample; the rows it picks depend on the partitioning."""
    return df.sample(withReplacement=False, fraction=min(max(fraction, 0.0), 1.0), seed=seed)


def sample_to_size(df: DataFrame, key: str, size: int) -> DataFrame:
    """About `size` rows, or all of them when there are no more; the count is a scalar subquery."""
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.filter(key_fraction(key, SIZE) < F.try_divide(F.lit(float(size)), total))


def sample_exactly(df: DataFrame, key: str, size: int, salt: str = SIZE) -> DataFrame:
    """The `size` rows with the smallest key hashes, or all of them when there are no more; equal keys are told apart by place.

    The hash below which they lie is found digit by digit: each step counts the rows per next four hexadecimal digits
    (at most 65,536 counts reach the driver) and goes into the group where the size is reached. No row is sorted.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat(F.lit(salt), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    prefix, left = "", size
    while len(prefix) < 32:
        digits = F.substring("_hash", len(prefix) + 1, 4).alias("digits")
        counts = sorted(tuple(r) for r in hashed.filter(F.col("_hash").startswith(prefix)).groupBy(digits).agg(F.count(F.lit(1))).collect())
        for group, n in counts:
            if n >= left:
                break
            left -= n
        else:
            return df if not prefix else hashed.filter(F.col("_hash") < prefix + "g").drop("_hash")
        prefix += group
        if n == left:
            return hashed.filter(F.col("_hash") < prefix + "g").drop("_hash")  # "g" follows all digits
    equal = hashed.filter(F.col("_hash") == prefix).limit(left)
    return hashed.filter(F.col("_hash") < prefix).unionByName(equal).drop("_hash")


def hash_split(df: DataFrame, key: str, train: float = 0.8, salt: str = "split") -> tuple[DataFrame, DataFrame]:
    """Train and test rows; a key stays on its side whatever the partitioning."""
    position = key_fraction(key, salt)
    return df.filter(position < train), df.filter(position >= train)


def spread(df: DataFrame, key: str, part_rows: int = PART_ROWS) -> DataFrame:
    """Rows dealt out by a unique key, for tables that training reads many times.

    Without it the number of tasks is that of the input files or of the last join. Hashing keeps a row in
    its place when a task is run again. The rows are counted first, as a task must not hold more of them when there
    are more: Spark sees only the shuffled bytes, and vectors and trees take many times as much.
    """
    parts = parts_for(df.count(), part_rows)
    return df.repartition(parts, key) if parts > 1 else df.repartition(key)


def parts_for(rows: int, part_rows: int = PART_ROWS) -> int:
    """Parts of about `part_rows` rows at most; 1, the choice is left to Spark, for a table of no more than `PART_ROWS` in all."""
    return 1 if rows <= PART_ROWS else max(LEAST_PARTS, -(-rows // part_rows))


def balanced_sample(features: DataFrame, ratio: float = 3.0, flag: str = "was_reopened", key: str = "key") -> DataFrame:
    """All positives and about `ratio` negatives for each of them."""
    counts = features.agg(F.count_if(F.col(flag)).alias("pos"), F.count_if(~F.col(flag)).alias("neg"))
    fraction = counts.select(F.try_divide(F.col("pos") * F.lit(float(ratio)), F.col("neg"))).scalar()
    return features.filter(F.col(flag) | (~F.col(flag) & (key_fraction(key, BALANCE) < fraction)))
