"""Classifiers: will a bug be reopened, is a comment positive, will an issue be slow."""

import time
from dataclasses import dataclass

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import CountVectorizer, NGram, StringIndexer, Word2Vec
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketscope.constants import NUMERIC_FEATURES, SLOW_COLUMNS
from ticketscope.functions.hashing import key_fraction
from ticketscope.functions.stages import assembled, encoded, filtered_words, hashed_words, word_counts
from ticketscope.operators.memory import keep
from ticketscope.operators.metrics import class_metrics
from ticketscope.operators.resolution import label_slow, mean_hours, resolution_hours
from ticketscope.operators.sampling import balanced_sample, hash_split, spread
from ticketscope.schemas import MODEL_COMPARISON, MODEL_METRICS, present

SEED = 42
FOLDS = 3
HELD_OUT = 0.2  # share of the keys on which the depth of the single tree is chosen
MERGED_PARTS = 4  # tasks for the merged rows, at most one row per combination, label, fold and side
WORD2VEC_PARTS = 8
TRAIN_ROWS = 25_000  # of the reopening models a task at most: forests hold some 5 KB a row, beside the rows they are made of
WORD_SLOTS = 2**17  # two 100-slot vectors of single precision each: 105 MB on the driver at most
ON_MERGED_ROWS = {"LogReg", "DecisionTree"}
DEPTHS = [5, 7]


@dataclass(frozen=True)
class ModelResult:
    """A fitted model, its quality on the test rows and how long it took to train."""

    name: str
    model: Model
    metrics: dict
    seconds: float


@dataclass(frozen=True)
class Datasets:
    """Train and test rows with `features` and `label`, the fitted pipeline, and the tables held for them."""

    train: DataFrame
    test: DataFrame
    pipeline: PipelineModel
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def best_model(results: list[ModelResult]) -> ModelResult:
    return max(results, key=lambda result: result.metrics["auc"])


def binary_metrics(model: Model, data: DataFrame) -> dict:
    """AUC, accuracy, weighted precision, recall and F1, and precision and recall of both labels."""
    predictions = model.transform(data).select("label", "rawPrediction", "prediction")
    auc = BinaryClassificationEvaluator(labelCol="label").evaluate(predictions)
    classes = class_metrics(predictions).collect()  # one row per label
    total = sum(row["support"] for row in classes)
    metrics = {"auc": float(auc), "accuracy": sum(row["tp"] for row in classes) / total}
    for name in ("precision", "recall", "f1"):
        metrics[name] = sum(row[name] * row["support"] for row in classes) / total
    for row in classes:
        metrics[f"precision_{int(row['label'])}"] = row["precision"]
        metrics[f"recall_{int(row['label'])}"] = row["recall"]
    return metrics


# --- reopened bugs ---------------------------------------------------------------------


def reopen_inputs(features: DataFrame) -> list[str]:
    """Assembler inputs of the reopening model, for the numbers the table has."""
    return ["project_vec", "priority_name_vec", "word_features", "ngram_features", *present(features, NUMERIC_FEATURES)]


def reopen_stages(
    features: DataFrame, partitions: int = WORD2VEC_PARTS, seed: int = SEED, word_slots: int = WORD_SLOTS
) -> Pipeline:
    """One-hot project and priority, word vectors, counted bigrams and the numbers in one vector, from `filtered_words`.

    `partitions` is the number of parts the word vectors are trained on at once; it does not follow the cluster's
    size, so the same rows give the same vectors on any number of cores. Words share `word_slots` hash slots, each with
    one vector, so the driver holds that many whatever the texts; words of one slot share its vector.
    """
    return Pipeline(stages=[
        *encoded(["project", "priority_name"]),
        hashed_words("filtered_words", "hashed_words", word_slots),
        Word2Vec(inputCol="hashed_words", outputCol="word_features", vectorSize=100, minCount=5, seed=seed,
                 numPartitions=partitions),
        NGram(n=2, inputCol="filtered_words", outputCol="ngrams"),
        CountVectorizer(inputCol="ngrams", outputCol="ngram_features", vocabSize=1000, minDF=5.0),
        assembled(reopen_inputs(features)),
    ])


def reopen_datasets(
    features: DataFrame, ratio: float = 3.0, partitions: int = WORD2VEC_PARTS, seed: int = SEED
) -> Datasets:
    """Balanced classes (one positive per `ratio` negatives) split by key, with the pipeline fitted on the train rows.

    Nulls are filled before the split. Texts are split into words once, unless the table has `filtered_words`; these
    rows are held, in place of the texts, until the data sets are released. The pipeline returned starts from
    `text_content`.
    """
    numbers = present(features, NUMERIC_FEATURES)
    text = "filtered_words" if "filtered_words" in features.columns else "text_content"
    columns = ["key", "project", "priority_name", text, "was_reopened", *numbers]
    balanced = balanced_sample(features.select(*columns).fillna(0, subset=numbers), ratio).withColumn(
        "label", F.col("was_reopened").cast("double")
    )
    words = PipelineModel(filtered_words("text_content"))
    rows = spread(balanced, "key", TRAIN_ROWS)
    rows = keep(rows if text == "filtered_words" else words.transform(rows).drop("text_content", "words"))
    train, test = hash_split(rows, "key")
    fitted = reopen_stages(features, partitions, seed).fit(train)
    pipeline = PipelineModel([*words.stages, *fitted.stages])
    return Datasets(fitted.transform(train), fitted.transform(test), pipeline, (rows,))


def reopen_estimators(trees: int = 100, seed: int = SEED) -> dict:
    return {
        "LogisticRegression": LogisticRegression(maxIter=10),
        "RandomForest": RandomForestClassifier(numTrees=trees, seed=seed),
        "GradientBoostedTrees": GBTClassifier(maxIter=10, seed=seed),
    }


def train_reopen_models(
    data: Datasets, models: list[str] | None = None, trees: int = 100, seed: int = SEED
) -> list[ModelResult]:
    """Fits the wanted models (all by default) and measures them on train (AUC) and test rows."""
    train, test = (keep(rows.select("features", "label")) for rows in (data.train, data.test))
    auc = BinaryClassificationEvaluator(labelCol="label")
    results = []
    try:
        for name, estimator in reopen_estimators(trees, seed).items():
            if models is not None and name not in models:
                continue
            start = time.monotonic()
            fitted = estimator.fit(train)
            seconds = time.monotonic() - start
            metrics = binary_metrics(fitted, test) | {"train_auc": float(auc.evaluate(fitted.transform(train)))}
            results.append(ModelResult(name, fitted, metrics, seconds))
    finally:
        train.unpersist()
        test.unpersist()
    return results


def model_metrics(spark: SparkSession, results: list[ModelResult]) -> DataFrame:
    """One row of AUC, precision, recall and F1 per model."""
    rows = [(r.name, *[float(r.metrics[m]) for m in ("auc", "precision", "recall", "f1")]) for r in results]
    return spark.createDataFrame(rows, MODEL_METRICS)


# --- comment sentiment -----------------------------------------------------------------


def sentiment_stages() -> Pipeline:
    """Label index of the category, and counted words of the cleaned text."""
    index = StringIndexer(inputCol="sentiment_category", outputCol="label", handleInvalid="skip")
    return Pipeline(stages=[index, *word_counts("cleaned_text", "features", 10000, 2.0)])


@dataclass(frozen=True)
class CommentVectors:
    """Comments with `label` and word counts in `features`, held, and the word pipeline fitted on all of them."""

    rows: DataFrame
    words: PipelineModel
    held: tuple[DataFrame, ...] = ()

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def comment_vectors(scored: DataFrame, key: str = "comment_id") -> CommentVectors:
    """Texts are cleaned, scored and split into words once; classifier and topics share the result until it is released."""
    text = keep(spread(scored.select(key, "cleaned_text", "sentiment_category"), key))
    words = sentiment_stages().fit(text)
    rows = keep(words.transform(text).select(key, "sentiment_category", "label", "features"))
    return CommentVectors(rows, words, (rows, text))


def sentiment_classifier(vectors: CommentVectors, key: str = "comment_id") -> tuple[DataFrame, Model]:
    """Test predictions of an elastic-net logistic regression and that model, which sees the train rows only."""
    train, test = hash_split(vectors.rows.select(key, "label", "features"), key)
    model = LogisticRegression(maxIter=10, regParam=0.01, elasticNetParam=0.8).fit(train)
    return model.transform(test).select(key, "label", "prediction"), model


# --- slow issues -----------------------------------------------------------------------


def slow_stages() -> Pipeline:
    """One-hot type, priority, project and status in one vector; nothing known only after creation but status."""
    return Pipeline(stages=[*encoded(SLOW_COLUMNS), assembled([f"{name}_vec" for name in SLOW_COLUMNS])])


def slow_datasets(issues: DataFrame, parity: bool = False) -> Datasets:
    """Resolved issues split by key, with raw columns next to `features` and `label`.

    The mean that sets the label and the pipeline come from the train rows; `parity` takes both from all rows.
    """
    resolved = resolution_hours(issues.select("key", *SLOW_COLUMNS, "created", "resolutiondate"))
    resolved = keep(spread(resolved.select("key", *SLOW_COLUMNS, "resolution_hours"), "key"))
    train, test = hash_split(resolved, "key")
    fitted_on = resolved if parity else train
    mean = mean_hours(fitted_on)
    pipeline = slow_stages().fit(fitted_on)
    columns = ["key", *SLOW_COLUMNS, "label", "features"]
    train, test = (pipeline.transform(label_slow(rows, mean)).select(*columns) for rows in (train, test))
    return Datasets(train, test, pipeline, (resolved,))


def folded_counts(train: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Equal rows merged into one with their number in `weight`, per fold and side of key-hashed splits.

    The vectors hold categories only, so a table of any length shrinks to its distinct combinations. Weighted
    by them, an unpenalised logistic regression and a single decision tree reach the optimum of the single rows.
    (One-hot columns with an intercept leave the regression's coefficients free along a line; only their fit agrees.)
    Forests and boosted trees draw rows at random, so they are trained on the rows themselves.
    """
    fold = F.floor(key_fraction("key", "fold") * folds).cast("int")
    aside = key_fraction("key", "held out") < HELD_OUT
    return (
        train.groupBy(*SLOW_COLUMNS, "label", fold.alias("fold"), aside.alias("held_out"))
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


def tuned_tree(rows: DataFrame, seed: int = SEED) -> Model:
    """A decision tree on `features`, `label`, `weight`; its depth is the better one on the `held_out` rows.

    Keys, not merged rows, decide who is held out, so merged and single rows choose alike.
    """
    auc = BinaryClassificationEvaluator(labelCol="label", weightCol="weight")
    aside, rest = rows.filter("held_out"), rows.filter("not held_out")

    def tree(depth: int) -> DecisionTreeClassifier:
        return DecisionTreeClassifier(maxDepth=depth, seed=seed, weightCol="weight")

    best = max(DEPTHS, key=lambda depth: (auc.evaluate(tree(depth).fit(rest).transform(aside)), -depth))
    return tree(best).fit(rows)


def slow_tuners(seed: int = SEED, parallelism: int = 2) -> dict:
    """What fits each model: forests choose a depth on a held-out fifth; logistic regression runs a 3-fold validation."""
    single = BinaryClassificationEvaluator(labelCol="label")
    weighted = BinaryClassificationEvaluator(labelCol="label", weightCol="weight")
    forests = {
        "RandomForest": RandomForestClassifier(numTrees=30, maxDepth=7, seed=seed),
        "GBT": GBTClassifier(maxIter=15, maxDepth=5, subsamplingRate=0.7, seed=seed),
    }
    splits = {
        name: TrainValidationSplit(
            estimator=forest, estimatorParamMaps=ParamGridBuilder().addGrid(forest.maxDepth, DEPTHS).build(),
            evaluator=single, trainRatio=1 - HELD_OUT, seed=seed, parallelism=parallelism,
        )
        for name, forest in forests.items()
    }
    splits["LogReg"] = CrossValidator(
        estimator=LogisticRegression(maxIter=50, weightCol="weight"), estimatorParamMaps=ParamGridBuilder().build(),
        evaluator=weighted, numFolds=FOLDS, foldCol="fold", seed=seed, parallelism=parallelism,
    )
    fits = {name: lambda rows, tuner=tuner: tuner.fit(rows).bestModel for name, tuner in splits.items()}
    return fits | {"DecisionTree": lambda rows: tuned_tree(rows, seed)}


def train_slow_models(
    data: Datasets, models: list[str] | None = None, seed: int = SEED, parallelism: int = 2
) -> list[ModelResult]:
    """Tunes and fits the wanted models (all by default) and measures them on the test rows.

    A model's time counts all of its work; merging rows, which two models share, counts for both.
    """
    rows = keep(data.train.select("features", "label"))
    if rows.isEmpty():
        rows.unpersist()
        raise ValueError("no resolved issue to train on")
    start = time.monotonic()
    merged = keep(data.pipeline.transform(folded_counts(data.train)).select("features", "label", "fold", "held_out", "weight").coalesce(MERGED_PARTS))
    merged.count()
    merging = time.monotonic() - start
    test = keep(data.test.select("features", "label"))
    results = []
    try:
        for name, fit in slow_tuners(seed, parallelism).items():
            if models is not None and name not in models:
                continue
            start = time.monotonic()
            fitted = fit(merged if name in ON_MERGED_ROWS else rows)
            seconds = time.monotonic() - start + (merging if name in ON_MERGED_ROWS else 0.0)
            results.append(ModelResult(name, fitted, binary_metrics(fitted, test), seconds))
    finally:
        for df in (rows, merged, test):
            df.unpersist()
    return results


def tagged_predictions(results: list[ModelResult], data: DataFrame) -> DataFrame:
    """Labels and predictions of all models, tagged with the model's name."""
    tagged = None
    for result in results:
        part = result.model.transform(data).select(F.lit(result.name).alias("Model"), "label", "prediction")
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged


def model_comparison(spark: SparkSession, results: list[ModelResult]) -> DataFrame:
    """One row per model, best AUC first. Precision and recall are those of label 0, as published."""
    rows = [
        (r.name, r.metrics["auc"], r.metrics["accuracy"], r.metrics.get("precision_0", 0.0),
         r.metrics.get("recall_0", 0.0), r.seconds)
        for r in results
    ]
    return spark.createDataFrame(rows, MODEL_COMPARISON).orderBy(F.desc("AUC"))
