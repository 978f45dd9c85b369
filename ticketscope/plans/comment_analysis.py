"""The whole comment analysis: sentiment, its classifier, topics and the link to resolution time."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ticketscope.operators.memory import keep
from ticketscope.operators.metrics import class_metrics, classification_report
from ticketscope.operators.models import comment_vectors, sentiment_classifier
from ticketscope.operators.sampling import sample_exactly
from ticketscope.operators.sentiment import (
    clean_text, sentiment, sentiment_distribution, sentiment_examples, sentiment_vs_resolution,
)
from ticketscope.operators.topics import fit_topics, topic_by_sentiment, topic_terms, topic_weights
from ticketscope.schemas import body_column


@dataclass
class CommentAnalysis:
    """Result tables by name; `release()` frees the tables they are computed from."""

    tables: dict[str, DataFrame]
    held: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.held:
            df.unpersist()


def run_comment_analysis(
    comments: DataFrame, issues: DataFrame | None = None, size: int | None = None, topics: int = 5
) -> CommentAnalysis:
    """All result tables. Issues are optional: without them, or without their dates, that table is left out.

    All comments are used; `size` thins longer tables to that many. Texts are cleaned and scored once and held
    until the analysis is released.
    """
    cleaned = clean_text(comments)
    if size is not None:
        cleaned = sample_exactly(cleaned, "comment_id", size)
    scored = keep(sentiment(cleaned))
    vectors = comment_vectors(scored)
    predictions, _ = sentiment_classifier(vectors)
    model = fit_topics(vectors.rows, topics)
    tables = {
        "sentiment_distribution": sentiment_distribution(scored),
        "sentiment_examples": sentiment_examples(scored, body=body_column(comments)),
        "classification_report": classification_report(predictions),
        "class_metrics": class_metrics(predictions),
        "topic_terms": topic_terms(model, vectors.words.stages[-1].vocabulary),
        "topic_by_sentiment": topic_by_sentiment(topic_weights(model, vectors.rows), topics),
    }
    if issues is not None and {"key", "created", "resolutiondate"} <= set(issues.columns):
        tables["sentiment_vs_resolution"] = sentiment_vs_resolution(scored, issues)
    return CommentAnalysis(tables, [scored, *vectors.held])
