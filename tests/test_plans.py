"""The composed analyses, run on the views of the smallest tables."""

from pathlib import Path

import pytest

from ticketscope.plans import bindings
from ticketscope.plans.activity_report import run_activity_report
from ticketscope.plans.comment_analysis import run_comment_analysis
from ticketscope.plans.slow_resolution import run_slow_resolution
from ticketscope.sources import read_csv, read_parquet

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test tables")


def test_comment_analysis(spark):
    comments = bindings.comments(spark, SF_DIR)
    tables = run_comment_analysis(comments, bindings.issues(spark, SF_DIR, text=False), topics=3).tables
    total = sum(row["count"] for row in tables["sentiment_distribution"].collect())
    assert total == comments.count()
    assert 0 <= tables["classification_report"].first()["accuracy"] <= 1
    assert tables["topic_terms"].count() == 3
    assert tables["sentiment_vs_resolution"].count() > 0
    assert tables["sentiment_examples"].count() <= 10
    assert tables["topic_by_sentiment"].count() == tables["sentiment_distribution"].count()


def test_comment_analysis_without_usable_issues(spark):
    comments = bindings.comments(spark, SF_DIR)
    for issues in (None, bindings.issues(spark, SF_DIR, text=False).drop("resolutiondate")):
        assert "sentiment_vs_resolution" not in run_comment_analysis(comments, issues, size=50, topics=2).tables


def test_slow_resolution(spark):
    tables = run_slow_resolution(bindings.issues(spark, SF_DIR, text=False), ["DecisionTree", "LogReg"]).tables
    assert {row["Model"] for row in tables["model_comparison"].collect()} == {"DecisionTree", "LogReg"}
    assert tables["confusion"].count() == 2
    assert tables["permutation_importance"].count() == 4
    assert sum(row["Importance"] for row in tables["coefficient_importance"].collect()) == pytest.approx(1.0)


def test_activity_report(spark, tmp_path):
    out = str(tmp_path / "out")
    tables = run_activity_report(
        bindings.raw_issues(spark, SF_DIR), bindings.raw_comments(spark, SF_DIR), bindings.raw_changelog(spark, SF_DIR),
        "2001-08-01", out,
    )
    assert read_parquet(spark, f"{out}/recent_resolution").count() == tables["recent_resolution"].count() > 0
    assert read_csv(spark, f"{out}/top_changed_fields").count() == tables["top_changed_fields"].count() == 4
    assert read_csv(spark, f"{out}/resolution_by_priority_status").count() > 0
