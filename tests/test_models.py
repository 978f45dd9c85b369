"""Trained models: invariants rather than fixed numbers, on the small tables and on tables with a known answer."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, Word2Vec
from pyspark.ml.linalg import Vectors
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ticketscope.functions.hashing import key_fraction
from ticketscope.functions.stages import hashed_words, slot_names
from ticketscope.operators import certificates, clusters, components, importance, models, silhouettes, topics
from ticketscope.operators.metrics import confusion_table
from ticketscope.operators.sentiment import clean_text, sentiment
from ticketscope.plans.bug_analysis import run_bug_analysis, summary
from ticketscope.sources import read_csv

WORDS = "crash login page button server memory slow timeout error config install upgrade".split()


@pytest.fixture(scope="module")
def features(spark):
    """Bugs whose reopening follows from their comment count."""
    draw = random.Random(5)
    rows = []
    for n in range(400):
        comments = draw.randrange(10)
        text = " ".join(draw.choices(WORDS, k=12))
        rows.append((f"P{n % 3}-{n}", f"P{n % 3}", draw.choice(["High", "Low", None]), draw.choice(["Open", "Closed"]),
                     text, text, comments >= 7, len(text), draw.choice([None, 40]), comments, draw.randrange(3), 2, None))
    return spark.createDataFrame(
        rows,
        "key string, project string, priority_name string, status_name string, summary string, text_content string, "
        "was_reopened boolean, summary_length int, description_length int, comment_count bigint, attachment_count bigint, "
        "status_change_count bigint, resolution_time_days int",
    ).persist()


@pytest.fixture(scope="module")
def issues(spark):
    """Resolved issues that are often slow in one project and seldom in another."""
    draw = random.Random(9)
    rows = []
    for n in range(3000):
        project = draw.choice(["slow", "quick", "even"])
        hours = {"slow": 40, "quick": 5, "even": 20}[project] + draw.randrange(60)
        rows.append((f"K-{n}", draw.choice(["Bug", "Task"]), draw.choice(["High", "Low"]), project, "Closed", hours))
    df = spark.createDataFrame(
        rows, "key string, issuetype_name string, priority_name string, project_name string, status_name string, hours int"
    )
    start = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    return df.withColumn("created", start).withColumn("resolutiondate", start + F.make_dt_interval(hours=F.col("hours"))).persist()


def test_reopen_models(spark, features):
    data = models.reopen_datasets(features)
    results = models.train_reopen_models(data, trees=10)
    assert [result.name for result in results] == ["LogisticRegression", "RandomForest", "GradientBoostedTrees"]
    for result in results:
        assert all(0 <= value <= 1 for value in result.metrics.values())
    assert models.best_model(results).metrics["auc"] > 0.9
    again = models.train_reopen_models(data, ["RandomForest"], trees=10)
    assert again[0].metrics == results[1].metrics

    forest = results[1].model
    inputs = models.reopen_inputs(features)
    everything = importance.feature_importance(forest, data.train, inputs, n=10_000)
    assert everything.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    assert importance.feature_importance(forest, data.train, inputs).first()["source"] == "comment_count"
    table = models.model_metrics(spark, results)
    assert table.count() == 3 and table.columns == ["model", "auc", "precision", "recall", "f1"]
    data.release()


def test_slots_are_named_after_their_labels(features):
    data = models.reopen_datasets(features)
    names = slot_names(data.train, models.reopen_inputs(features))
    size = len(data.train.select("features").first()[0])
    assert len(names) == size and [slot for slot, _, _ in names] == list(range(size))
    assert {"project=P0", "project=P1", "project=P2"} <= {name for _, source, name in names if source == "project"}
    data.release()


def test_slow_models(spark, issues):
    data = models.slow_datasets(issues)
    results = models.train_slow_models(data)
    assert {result.name for result in results} == {"RandomForest", "GBT", "DecisionTree", "LogReg"}
    assert all(0.7 < result.metrics["auc"] < 0.9 for result in results)
    rows = models.model_comparison(spark, results).collect()
    assert [row["AUC"] for row in rows] == sorted((row["AUC"] for row in rows), reverse=True)
    cells = confusion_table(models.tagged_predictions(results, data.test)).collect()
    tested = data.test.count()
    assert len(cells) == 4 and all(row["TP"] + row["FP"] + row["TN"] + row["FN"] == tested for row in cells)

    regression = next(result.model for result in results if result.name == "LogReg")
    shares = importance.grouped_coef_importance(
        regression, data.train, [f"{name}_vec" for name in models.SLOW_COLUMNS]
    ).collect()
    assert sum(row["Importance"] for row in shares) == pytest.approx(1.0)
    assert shares[0]["Feature"] == "project_name"

    test = data.test.drop("features")
    losses = importance.permutation_importance(regression, data.pipeline, test, models.SLOW_COLUMNS).collect()
    assert losses[0]["feature"] == "project_name" and losses[0]["importance"] > 0.1
    assert all(abs(row["importance"]) < 0.05 for row in losses[1:])
    data.release()


def test_threshold_from_train_or_from_all(issues):
    assert models.slow_datasets(issues, parity=True).train.count() == models.slow_datasets(issues).train.count()


def test_merged_rows_train_the_same_models(issues):
    data = models.slow_datasets(issues)
    merged = data.pipeline.transform(models.folded_counts(data.train))
    assert merged.agg(F.sum("weight")).first()[0] == data.train.count()
    single = LogisticRegression(maxIter=50).fit(data.train)
    weighted = LogisticRegression(maxIter=50, weightCol="weight").fit(merged)
    assert merged.count() < data.train.count() / 10
    assert weighted.coefficients.toArray() == pytest.approx(single.coefficients.toArray(), abs=1e-3)
    assert weighted.intercept == pytest.approx(single.intercept, abs=1e-3)
    tree = DecisionTreeClassifier(maxDepth=5).fit(data.train)
    merged_tree = DecisionTreeClassifier(maxDepth=5, weightCol="weight").fit(merged)
    assert merged_tree.depth == tree.depth and merged_tree.numNodes == tree.numNodes
    probability = vector_to_array("probability").getItem(1)
    single, weighted = (
        {row["key"]: row["p"] for row in m.transform(data.test).select("key", probability.alias("p")).collect()}
        for m in (tree, merged_tree)
    )
    assert weighted == pytest.approx(single)
    keyed = data.train.withColumns({"held_out": key_fraction("key", "held out") < models.HELD_OUT, "weight": F.lit(1.0)})
    assert models.tuned_tree(merged).getMaxDepth() == models.tuned_tree(keyed).getMaxDepth()
    data.release()


def test_no_row_to_train_on_is_said(issues):
    data = models.slow_datasets(issues.filter("resolutiondate is not null").limit(40))
    with pytest.raises(ValueError, match="no resolved issue"):
        models.train_slow_models(models.Datasets(data.train.filter("false"), data.test, data.pipeline))
    data.release()


def test_permutation_keeps_all_values_and_moves_them(spark):
    df = spark.range(5000).selectExpr("concat('k', id) as key", "cast(id as string) as a", "case when id % 3 = 0 then null else id end as b")
    mixed = importance.permuted_columns(df, ["a", "b"]).persist()
    assert mixed.count() == 5000 and mixed.columns == ["key", "a", "b", "_permuted"]
    assert mixed.select("_permuted.a").distinct().count() == 5000
    assert mixed.filter("_permuted.b is null").count() == df.filter("b is null").count()
    assert mixed.filter("a = _permuted.a").count() == 0
    # Neither ranges nor partitions change who takes whose values.
    want = {r["key"]: r["_permuted"]["a"] for r in mixed.collect()}
    for ranges, parts in ((1, 1), (3, 7), (5000, 2)):
        other = importance.permuted_columns(df.repartition(parts), ["a", "b"], ranges=ranges)
        assert {r["key"]: r["_permuted"]["a"] for r in other.collect()} == want
    assert importance.permuted_columns(df.limit(0), ["a"]).count() == 0
    assert importance.permuted_columns(df.filter("key = 'k7'"), ["a"]).first()["_permuted"]["a"] == "7"


def test_sentiment_model_and_topics(spark):
    draw = random.Random(1)
    endings = ["all good and great", "broken again crash", "nothing special here"]
    rows = [(str(n), f"A-{n % 9}", " ".join(draw.choices(WORDS[:4] + WORDS[5:8], k=6)) + " " + draw.choice(endings)) for n in range(300)]
    scored = sentiment(clean_text(spark.createDataFrame(rows, "comment_id string, key string, body string")))
    vectors = models.comment_vectors(scored)
    predictions, _ = models.sentiment_classifier(vectors)
    words = vectors.words
    assert predictions.filter("label = prediction").count() > 0.9 * predictions.count() > 0
    vocabulary = words.stages[-1].vocabulary
    assert "" not in vocabulary and "and" not in vocabulary

    prepared = words.transform(scored).persist()
    model = topics.fit_topics(prepared, k=3)
    terms = topics.topic_terms(model, vocabulary).collect()
    assert len(terms) == 3 and all(len(row["termWords"]) == 3 and set(row["termWords"]) <= set(vocabulary) for row in terms)
    assert all(row["termWeights"] == sorted(row["termWeights"], reverse=True) for row in terms)
    weights = topics.topic_weights(model, prepared)
    for row in topics.topic_by_sentiment(weights, 3).collect():
        assert sum(row[f"avg_topic_{i}"] for i in range(3)) == pytest.approx(1.0, abs=1e-4)


def test_clusters(spark, features):
    vectors, _ = clusters.cluster_features(features)
    vectors = vectors.persist()
    scores = clusters.scan_k(vectors, [2, 3])
    assert all(-1 <= score <= 1 for _, score in scores)
    assert clusters.best_k([(2, 0.5), (3, 0.7), (4, 0.7)]) == 3
    for algorithm in ("kmeans", "bisecting"):
        clustered = clusters.cluster(vectors, 3, algorithm)
        assert sum(row["count"] for row in clusters.cluster_counts(clustered).collect()) == 400
    points = clusters.pca_projection(clustered, 3)
    assert points.columns == ["key", "prediction", "was_reopened", "x", "y", "z3"] and points.count() == 400
    sampled, _ = clusters.cluster_features(features, fraction=0.5)
    assert 150 < sampled.count() < 250


def test_keyword_ties_share_their_rank(spark):
    df = spark.createDataFrame([(0, list("aaabbccd")), (1, ["x"]), (1, []), (None, ["y"])], "prediction int, filtered_words array<string>")
    rows = [tuple(row) for row in clusters.cluster_keywords(df, 2).orderBy("prediction", "rank", "word").collect()]
    assert rows == [(None, "y", 1, 1), (0, "a", 3, 1), (0, "b", 2, 2), (0, "c", 2, 2), (1, "x", 1, 1)]


def test_extremes_take_the_lower_cluster_on_a_tie(spark):
    rows = [(3, True), (1, True), (2, False), (0, False)]
    df = spark.createDataFrame(rows, "prediction int, was_reopened boolean")
    for name in clusters.TRAITS.values():
        df = df.withColumn(name, F.col("prediction"))
    picked = {row["extreme"]: row["prediction"] for row in clusters.cluster_extremes(df).collect()}
    assert picked == {"highest": 1, "lowest": 0}


def test_whole_analysis(spark, tmp_path):
    start = F.lit("2020-01-01 00:00:00").cast("timestamp_ntz")
    issues = spark.range(600).selectExpr(
        "concat('P', id % 3, '-', id) as key", "case when id % 4 = 0 then 'Task' else 'Bug' end as issuetype_name",
        "case when id % 5 = 0 then 'High' else 'Low' end as priority_name", "'Open' as status_name",
        "concat('login page ', id % 7) as summary", "repeat('server crash ', cast(id % 11 as int)) as description",
    ).withColumns({"created": start, "updated": start, "resolutiondate": start})
    changelog = spark.range(1800).selectExpr(
        "id", "concat('P', id % 600 % 3, '-', id % 600) as key", "'status' as field",
        "case when id % 600 % 6 = 1 and id > 1200 then 'Closed' else 'Open' end as fromString",
        "case when id % 600 % 6 = 1 and id > 600 and id < 1200 then 'Closed' else 'In Progress' end as toString",
    ).withColumn("created", start + F.make_dt_interval(mins=F.col("id").cast("int")))
    analysis = run_bug_analysis(
        spark, issues, changelog, str(tmp_path / "out"), models=["LogisticRegression", "RandomForest"], ks=[2, 3], trees=5
    )
    assert analysis.tables["reopen_share"].first()["total_bugs"] == 450
    assert analysis.k in (2, 3)
    counts = read_csv(spark, str(tmp_path / "out" / "cluster_counts")).collect()
    assert sum(int(row["count"]) for row in counts) == 450
    saved = read_csv(spark, str(tmp_path / "out" / "reopening_model_metrics")).collect()
    assert {row["model"] for row in saved} == {"LogisticRegression", "RandomForest"}
    rates = [float(row["reopening_rate"]) for row in read_csv(spark, str(tmp_path / "out" / "cluster_reopening_rates")).collect()]
    assert rates == sorted(rates, reverse=True)
    rows = summary(spark, analysis).collect()
    assert sum(row["value"] for row in rows if row["section"] == "cluster size") == 450
    for table in analysis.tables.values():
        table.collect()
    analysis.release()


def test_analysis_holds_no_parts_of_vectors_and_no_training_rows(spark, features):
    """Clusters come after the models, when only the bugs and their vectors may take up memory."""
    issues = features.withColumns({"issuetype_name": F.lit("Bug"), "description": F.col("text_content")}).select(
        "key", "issuetype_name", "priority_name", "status_name", "summary", "description",
        *[F.lit("2020-01-01").cast("timestamp_ntz").alias(name) for name in ("created", "updated", "resolutiondate")],
    )
    changes = features.filter("was_reopened").selectExpr(
        "key as id", "key", "timestamp_ntz '2020-01-02' as created", "'status' as field", "'Closed' as fromString", "'Reopened' as toString"
    )
    analysis = run_bug_analysis(spark, issues, changes, models=["LogisticRegression"], ks=[2])
    assert "features" in analysis.clustered.columns
    assert not {"text_features", "project_vec", "project_idx"} & set(analysis.clustered.columns)
    assert len(analysis.held) == 2
    analysis.release()


@pytest.fixture(scope="module")
def sparse(spark):
    """Sparse, dense and empty vectors of 40 slots in three loose groups."""
    draw = np.random.default_rng(8)
    rows = []
    for n in range(900):
        x = np.where(draw.random(40) < 0.2, draw.normal(size=40), 0) + np.where(np.arange(40) % 3 == n % 3, 2.0 * (n % 3), 0)
        if n % 100 == 99:
            x[:] = 0
        held = np.flatnonzero(x)
        rows.append((n, Vectors.dense(x) if n % 5 == 0 else Vectors.sparse(40, held, x[held])))
    return spark.createDataFrame(rows, ["key", "features"]).repartition(5).persist()


def test_components_equal_those_of_the_covariance(spark, sparse):
    found = components.principal_components(sparse, 3)
    want = PCA(k=3, inputCol="features", outputCol="out").fit(sparse)
    assert np.abs(np.abs(want.pc.toArray()) - np.abs(found.directions)).max() < 1e-6
    assert np.allclose(found.shares, want.explainedVariance.toArray(), atol=1e-8)
    points = {r["key"]: (r["x"], r["y"]) for r in components.projected(sparse, found, ["x", "y", "z3"], ["key"]).collect()}
    for row in sparse.collect():
        assert np.allclose(points[row["key"]], row["features"].toArray() @ found.directions[:, :2])
    assert [r["violations"] for r in certificates.component_violations(sparse, found).collect()] == [0, 0, 0]
    turned = found.directions.copy()
    turned[:, 1] = turned[:, 1] * 1.01
    off = components.Components(turned, found.variances, found.shares, found.residuals, found.mean, found.passes)
    assert {r["component"]: r["violations"] > 0 for r in certificates.component_violations(sparse, off).collect()}[2]
    # Fewer rows than directions, and rows that do not differ.
    few = components.principal_components(sparse.filter("key in (1, 2)"), 2)
    assert few.variances[1] < 1e-9 * few.variances[0] and few.variances[0] > 0
    assert (components.principal_components(sparse.filter("key = 1"), 2).variances < 1e-9).all()


def test_silhouettes_of_many_k_at_once(spark, sparse):
    fitted = silhouettes.fitted(sparse, [2, 3, 5])
    scores = silhouettes.silhouettes(sparse, {k: m.clusterCenters() for k, m in fitted.items()})
    for k, model in fitted.items():
        assert scores[k] == pytest.approx(ClusteringEvaluator().evaluate(model.transform(sparse)), abs=1e-12)
    sample = silhouettes.coreset(sparse, size=200).persist()
    assert 120 < sample.count() < 300 and abs(sample.agg(F.sum("weight")).first()[0] - 900) < 250
    assert clusters.best_k(clusters.scan_k(sparse, [2, 3, 5])) == max(scores, key=scores.get)


def test_centres_are_certified(spark, sparse):
    model = clusters.cluster_model(sparse, 3, max_iter=200, tol=0.0)
    placed = model.transform(sparse).persist()
    good = certificates.centre_violations(placed, model.clusterCenters()).collect()
    assert sum(r["rows"] for r in good) == 900 and all(r["wrong_rows"] == r["wrong_slots"] == 0 for r in good)
    moved = [c * (1.01 if i == 1 else 1) for i, c in enumerate(model.clusterCenters())]
    assert {r["prediction"] for r in certificates.centre_violations(placed, moved).collect() if r["wrong_slots"]} == {1}
    swapped = model.clusterCenters()[::-1]
    assert sum(r["wrong_rows"] for r in certificates.centre_violations(placed, swapped).collect()) > 100


def test_regression_and_tree_are_certified(spark, issues):
    data = models.slow_datasets(issues)
    merged = data.pipeline.transform(models.folded_counts(data.train)).persist()
    model = LogisticRegression(maxIter=300, tol=1e-12, weightCol="weight").fit(merged)
    rows = certificates.score_equations(model, merged, ["project_name", "priority_name"], "weight").collect()
    assert len(rows) == 5 and all(abs(r["expected"] - r["seen"]) < 1e-3 for r in rows)
    early = LogisticRegression(maxIter=1, weightCol="weight").fit(merged)
    assert any(abs(r["expected"] - r["seen"]) > 1 for r in certificates.score_equations(early, merged, ["project_name"], "weight").collect())
    tree = models.tuned_tree(merged)
    assert certificates.leaf_violations(tree, merged, "weight").first()["wrong_leaves"] == 0
    assert certificates.leaf_violations(tree, merged.filter("priority_name = 'High'"), "weight").first()["wrong_leaves"] > 0
    # Merged and single rows give the same shares, whatever line their fits stopped on.
    inputs = [f"{n}_vec" for n in ("issuetype_name", "priority_name", "project_name", "status_name")]
    single = LogisticRegression(maxIter=300, tol=1e-12).fit(data.train)
    one, two = ({r["Feature"]: r["Importance"] for r in importance.grouped_coef_importance(m, d, inputs).collect()} for m, d in ((model, merged), (single, data.train)))
    assert one.keys() == two.keys() and all(abs(one[f] - two[f]) < 1e-3 for f in one)
    data.release()


def test_word_vectors_of_slots(spark):
    """Without shared slots the vectors are those of the words; with few slots there are no more vectors than slots."""
    words = [w for n in range(40) for w in [f"word{n}"] * (n + 5)]
    rows = spark.createDataFrame([(i, words[i::7]) for i in range(7)], "key int, filtered_words array<string>").coalesce(1)
    train = lambda slots: Pipeline(stages=[hashed_words("filtered_words", "hashed_words", slots), word2vec("hashed_words")])
    word2vec = lambda column: Word2Vec(inputCol=column, outputCol="x", vectorSize=8, minCount=5, seed=1, numPartitions=1)
    vectors = lambda model: [r["x"].toArray() for r in model.transform(rows).orderBy("key").collect()]
    wide = train(2**40).fit(rows)
    assert np.allclose(vectors(wide), vectors(word2vec("filtered_words").fit(rows)), atol=1e-6)
    assert train(6).fit(rows).stages[-1].getVectors().count() <= 6
