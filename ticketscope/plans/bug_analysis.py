"""The whole bug analysis: reopening, models, clusters, reports and summary."""

from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.operators.cleaning import bug_share, load_bugs
from ticketscope.operators.clusters import (
    best_k, cluster_counts, cluster_examples, cluster_extremes, cluster_features, cluster_keywords,
    cluster_reopen_rates, cluster, scan_k, with_words,
)
from ticketscope.operators.importance import feature_importance
from ticketscope.operators.memory import keep
from ticketscope.operators.models import (
    ModelResult, best_model, model_metrics, reopen_datasets, reopen_inputs, train_reopen_models,
)
from ticketscope.operators.reopening import (
    flag_bugs, reopen_examples, reopen_features, reopen_flags, reopen_profile, reopen_share,
)
from ticketscope.sources.published import publish
from ticketscope.sources.readers import read_csv
from ticketscope.sources.writers import write_report


@dataclass
class BugAnalysis:
    """Results of one run; `release()` frees the tables they are computed from."""

    models: list[ModelResult]
    clustered: DataFrame
    k: int
    silhouettes: list[tuple[int, float]]
    tables: dict[str, DataFrame]
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def run_bug_analysis(
    spark: SparkSession,
    issues: DataFrame,
    changelog: DataFrame | None = None,
    out: str | None = None,
    sample: float | None = None,
    cluster_fraction: float = 1.0,
    models: list[str] | None = None,
    ks: range | list[int] = range(2, 6),
    trees: int = 50,
) -> BugAnalysis:
    """Runs every step; reports are published below `out` when it is given.

    `sample` thins the issues first. Clusters use all bugs; `cluster_fraction=0.1` is the usual choice to
    save time above some 10,000 of them.
    """
    bugs, changes = load_bugs(issues, changelog, sample)
    flagged = flag_bugs(bugs, reopen_flags(changes) if changes is not None else None)
    features = keep(with_words(reopen_features(flagged, changes)))  # words, split once for models and clusters

    data = reopen_datasets(features)
    results = train_reopen_models(data, models, trees)
    data.release()  # its columns, not its rows, are asked for below
    best = best_model(results)

    vectors, _ = cluster_features(features, cluster_fraction)
    vectors = keep(vectors.select(*features.columns, "features"))  # not the parts that `features` is put together from
    scores = scan_k(vectors, ks)
    k = best_k(scores)
    clustered = cluster(vectors, k)

    tables = {
        "bug_share": bug_share(issues),
        "reopen_share": reopen_share(features),
        "reopen_examples": reopen_examples(features),
        "reopen_profile": reopen_profile(features),
        "model_metrics": model_metrics(spark, results),
        "cluster_counts": cluster_counts(clustered),
        "cluster_keywords": cluster_keywords(clustered),
        "cluster_examples": cluster_examples(clustered),
        "cluster_reopening_rates": cluster_reopen_rates(clustered),
        "cluster_extremes": cluster_extremes(clustered),
    }
    if hasattr(best.model, "featureImportances"):
        tables["feature_importance"] = feature_importance(best.model, data.train, reopen_inputs(features))
    analysis = BugAnalysis(results, clustered, k, scores, tables, [features, vectors])
    if out is not None:
        save_results(spark, tables, out)
    return analysis


def save_results(spark: SparkSession, tables: dict[str, DataFrame], out: str) -> dict[str, str]:
    """Publishes model metrics, cluster sizes and reopening rates as CSV reports that appear together; returns their paths.

    Copies under the plain names `<out>/<report>` follow, for readers of fixed paths; only the published reports are
    sure to be of one run.
    """
    reports = {
        "reopening_model_metrics": ("model_metrics", ["model"]),
        "cluster_counts": ("cluster_counts", ["prediction"]),
        "cluster_reopening_rates": ("cluster_reopening_rates", [F.desc("reopening_rate"), "prediction"]),
    }
    paths = publish(spark, out, {
        name: partial(write_report, tables[table], order_by=order) for name, (table, order) in reports.items()
    })
    for name, path in paths.items():
        write_report(read_csv(spark, path), f"{out}/{name}")
    return paths


def summary(spark: SparkSession, analysis: BugAnalysis) -> DataFrame:
    """Best model and its metrics, number of clusters, silhouette and cluster sizes as (section, item, value)."""
    best = best_model(analysis.models)
    rows = [("best model", best.name, None)]
    rows += [("best model", name, float(best.metrics[name])) for name in ("auc", "precision", "recall", "f1")]
    rows += [("clusters", "k", float(analysis.k)), ("clusters", "silhouette", dict(analysis.silhouettes)[analysis.k])]
    sizes = cluster_counts(analysis.clustered).select(
        F.lit("cluster size").alias("section"),
        F.col("prediction").cast("string").alias("item"),
        F.col("count").cast("double").alias("value"),
    )
    return spark.createDataFrame(rows, "section string, item string, value double").unionByName(sizes)
