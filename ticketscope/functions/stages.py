"""Shared pipeline stages, and the names behind the slots of an assembled vector."""

from pyspark.ml.feature import (
    CountVectorizer, OneHotEncoder, RegexTokenizer, SQLTransformer, StopWordsRemover, StringIndexer, VectorAssembler,
)
from pyspark.sql import DataFrame


def encoded(columns: list[str]) -> list:
    """Index and one-hot stages for all columns at once; unseen and null values get a slot of their own."""
    indexes = [f"{name}_idx" for name in columns]
    return [
        StringIndexer(inputCols=columns, outputCols=indexes, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexes, outputCols=[f"{name}_vec" for name in columns], handleInvalid="keep"),
    ]


def filtered_words(text: str) -> list:
    """Lower-cased words in `words`, without stop words in `filtered_words`; never an empty word."""
    return [
        RegexTokenizer(inputCol=text, outputCol="words", pattern=r"\s+", minTokenLength=1),
        StopWordsRemover(inputCol="words", outputCol="filtered_words"),
    ]


def hashed_words(words: str, output: str, slots: int) -> SQLTransformer:
    """Words replaced by the number of their hash slot, so that no more than `slots` different ones are left."""
    return SQLTransformer(
        statement=f"SELECT *, transform({words}, w -> cast(pmod(xxhash64(w), {slots}) AS string)) AS {output} FROM __THIS__"
    )


def counted_words(output: str, vocab_size: int, min_df: float) -> CountVectorizer:
    return CountVectorizer(inputCol="filtered_words", outputCol=output, minDF=min_df, vocabSize=vocab_size)


def word_counts(text: str, output: str, vocab_size: int, min_df: float) -> list:
    return [*filtered_words(text), counted_words(output, vocab_size, min_df)]


def assembled(columns: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")


def slot_names(df: DataFrame, inputs: list[str], features: str = "features") -> list[tuple[int, str, str]]:
    """(slot, source column, feature name) for each slot of a vector assembled from `inputs`.

    The vector's metadata names each slot after its input, as `input` or `input_value`.
    """
    groups = df.schema[features].metadata["ml_attr"]["attrs"].values()
    named = sorted((attribute["idx"], attribute["name"]) for group in groups for attribute in group)
    slots = []
    for slot, name in named:
        column = max((c for c in inputs if name == c or name.startswith(f"{c}_")), key=len)
        source = column.removesuffix("_vec")
        label = name if source == column else f"{source}={name[len(column) + 1:]}"
        slots.append((slot, source, label))
    return slots
