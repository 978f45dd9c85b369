"""Rows with every odd case: nulls, empty, long and repeated texts, ties, columns with clashing names."""

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
COMMON = "the of and to in is it on for with".split()
RARE = [a + b + c for a in "bcdfgklm" for b in "aeiou" for c in "rstnl"]


def prose(rng: random.Random, n: int) -> str:
    words = [rng.choice(COMMON) if rng.random() < 0.5 else rng.choice(RARE) + rng.choice(RARE) for _ in range(n)]
    return "".join(w + ("\n" if i % 17 == 16 else " ") for i, w in enumerate(words)).strip()


def odd_documents(spark: SparkSession) -> DataFrame:
    """(doc_id, text, lang, source, n_chars, size, words, key, u, copies): ids with a null, a tie and a repeated row."""
    rng = random.Random(7)
    base = [prose(rng, n) for n in (60, 80, 120, 200, 9, 2, 1, 30, 55)]
    near = base[3].split(" ")
    near[50] = "changed"
    texts = [None, "", " \t\n", *base, base[2], base[2], " ".join(near), base[3] + "\n" + base[1], "Ünï Ærø ÉÀ  x #*$%", prose(rng, 6000)]
    rows = [(i, t, "en", ("s1", None, "s2", "")[i % 4], len(t or ""), -1, "w", "k", 0, 9) for i, t in enumerate(texts)]
    rows += [(None, base[0], None, None, None, None, None, None, None, None), (5, base[4], "en", "s9", 1, 1, "w", "k", 0, 1), rows[4], rows[4]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long, words string, key string, u long, copies long").repartition(3)


def documents(spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def none_of(df: DataFrame) -> DataFrame:
    return df.filter(F.lit(False))


def rows_of(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
