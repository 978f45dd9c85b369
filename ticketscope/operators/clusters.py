"""Bug clusters: features, number of clusters, assignment, and what marks each cluster."""

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketscope.functions.hashing import CLUSTERS
from ticketscope.functions.stages import assembled, counted_words, encoded, filtered_words
from ticketscope.operators.components import principal_components, projected
from ticketscope.operators.sampling import hash_sample, spread
from ticketscope.operators.silhouettes import fitted, silhouettes
from ticketscope.schemas import present

SEED = 42
TRAITS = {
    "avg_comments": "comment_count",
    "avg_attachments": "attachment_count",
    "avg_summary_length": "summary_length",
    "avg_description_length": "description_length",
    "avg_status_changes": "status_change_count",
}


def with_words(bugs: DataFrame) -> DataFrame:
    """Bugs with their words in `filtered_words` in place of the text. Persist the result: every fit reads it."""
    return PipelineModel(filtered_words("text_content")).transform(spread(bugs, "key")).drop("text_content", "words")


def cluster_features(
    bugs: DataFrame, fraction: float = 1.0, vocab_size: int = 5000, min_df: float = 2.0
) -> tuple[DataFrame, PipelineModel]:
    """Bugs with a `features` vector of word counts, one-hot categories and numbers, and the fitted pipeline.

    Pass bugs that already have their words (`with_words`), persisted: fit and transform then split no text again.
    """
    if fraction < 1.0:
        bugs = hash_sample(bugs, "key", fraction, CLUSTERS)
    categories = present(bugs, ["project", "priority_name", "status_name"])
    numbers = present(bugs, ["summary_length", "description_length", "comment_count", "attachment_count"])
    bugs = (bugs if "filtered_words" in bugs.columns else with_words(bugs)).fillna(0, subset=numbers)
    stages = [
        counted_words("text_features", vocab_size, min_df),
        *encoded(categories),
        assembled(["text_features", *[f"{name}_vec" for name in categories], *numbers]),
    ]
    model = Pipeline(stages=stages).fit(bugs)
    return model.transform(bugs), model


def scan_k(vectors: DataFrame, ks: range | list[int] = range(2, 11), seed: int = SEED, key: str = "key") -> list[tuple[int, float]]:
    """(k, silhouette) of k-means for each k, fitted on one coreset and judged on all rows. Pass persisted vectors."""
    models = fitted(vectors, ks, key=key, seed=seed)
    scores = silhouettes(vectors, {k: model.clusterCenters() for k, model in models.items()})
    return [(k, scores[k]) for k in ks]


def best_k(scores: list[tuple[int, float]]) -> int:
    """The k with the highest silhouette; the smaller one on a tie."""
    return max(scores, key=lambda score: (score[1], -score[0]))[0]


def cluster_model(vectors: DataFrame, k: int, algorithm: str = "kmeans", seed: int = SEED, max_iter: int = 20, tol: float = 1e-4) -> Model:
    """A fitted model; `max_iter` bounds the rounds of either algorithm, `tol` the last move of a k-means centre."""
    estimators = {
        "kmeans": lambda: KMeans(k=k, seed=seed, featuresCol="features", initMode="k-means||", maxIter=max_iter, tol=tol),
        "bisecting": lambda: BisectingKMeans(k=k, seed=seed, featuresCol="features", maxIter=max_iter),
    }
    return estimators[algorithm]().fit(vectors)


def cluster(vectors: DataFrame, k: int, algorithm: str = "kmeans", seed: int = SEED) -> DataFrame:
    """Vectors with their cluster in `prediction`."""
    return cluster_model(vectors, k, algorithm, seed).transform(vectors)


def cluster_counts(clustered: DataFrame, by: str = "prediction") -> DataFrame:
    """Rows per cluster, in cluster order."""
    return clustered.groupBy(by).agg(F.count(F.lit(1)).alias("count")).orderBy(by)


def cluster_keywords(
    clustered: DataFrame, n: int = 10, by: str = "prediction", words: str = "filtered_words"
) -> DataFrame:
    """Words of rank 1 to n by frequency in each cluster; ties share a rank, so there may be more than n.

    Frequencies are ranked, not words: a cluster has few different ones, however many words it has, and at
    most n of them are kept to pick the words by.
    """
    # Exploding a plain column would make Spark split the text again in a filter for empty lists.
    word = F.explode(F.array_compact(words)).alias("word")
    counts = clustered.select(by, word).groupBy(by, "word").agg(F.count(F.lit(1)).alias("count"))
    more_frequent = Window.partitionBy(by).orderBy(F.desc("count")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = (
        counts.groupBy(by, "count")
        .agg(F.count(F.lit(1)).alias("words"))
        .withColumn("rank", F.coalesce(F.sum("words").over(more_frequent), F.lit(0)) + 1)
        .filter(F.col("rank") <= n)
        .select(F.col(by).alias("_by"), F.col("count").alias("_count"), "rank")
    )
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col("count") == F.col("_count"))
    return counts.join(ranks, same).select(by, "word", "count", "rank")


def cluster_examples(clustered: DataFrame, n: int = 3, by: str = "prediction") -> DataFrame:
    """The first n bugs of each cluster by key."""
    first = F.row_number().over(Window.partitionBy(by).orderBy("key"))
    return clustered.select(by, "key", "summary").withColumn("example", first).filter(F.col("example") <= n)


def cluster_reopen_rates(clustered: DataFrame, by: str = "prediction") -> DataFrame:
    """Bugs, reopened bugs and their ratio per cluster, highest ratio first."""
    return (
        clustered.groupBy(by)
        .agg(F.count(F.lit(1)).alias("total_bugs"), F.count_if("was_reopened").alias("reopened_bugs"))
        .withColumn("reopening_rate", F.col("reopened_bugs") / F.col("total_bugs"))
        .orderBy(F.desc("reopening_rate"), by)
    )


def cluster_extremes(clustered: DataFrame, by: str = "prediction") -> DataFrame:
    """Averages of the clusters with the highest and the lowest reopening rate; the lower cluster on a tie.

    One aggregation yields the rate and averages of all clusters; the two rows are picked from it.
    """
    per_cluster = (
        clustered.groupBy(by)
        .agg(
            (F.count_if("was_reopened") / F.count(F.lit(1))).alias("reopening_rate"),
            *[F.avg(column).alias(name) for name, column in TRAITS.items()],
        )
    )
    row = F.struct(F.col(by), "reopening_rate", *TRAITS)
    # The smallest (-rate, cluster) is the highest rate with the lowest cluster.
    picked = per_cluster.agg(
        F.min_by(row, F.struct(-F.col("reopening_rate"), F.col(by))).alias("highest"),
        F.min_by(row, F.struct(F.col("reopening_rate"), F.col(by))).alias("lowest"),
    )
    rows = F.expr("stack(2, 'highest', highest, 'lowest', lowest) as (extreme, c)")
    return picked.select(rows).select("extreme", "c.*")


def pca_projection(clustered: DataFrame, k: int = 2) -> DataFrame:
    """Cluster, reopening flag and the first k principal components (x, y, then z3, z4, ...).

    Vectors may be as wide as the clustered ones: no matrix square in their size is built.
    """
    axes = (["x", "y"] + [f"z{i}" for i in range(3, k + 1)])[:k]
    return projected(clustered, principal_components(clustered, k), axes, present(clustered, ["key", "prediction", "was_reopened"]))
