"""The whole slow-issue study: four tuned classifiers, how they compare and what they rely on."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ticketscope.operators.importance import grouped_coef_importance, permutation_importance
from ticketscope.operators.metrics import confusion_table
from ticketscope.constants import SLOW_COLUMNS
from ticketscope.operators.models import (
    Datasets, best_model, model_comparison, slow_datasets, tagged_predictions, train_slow_models,
)


@dataclass
class SlowResolution:
    """Result tables by name; `release()` frees the tables they are computed from."""

    tables: dict[str, DataFrame]
    data: Datasets

    def release(self) -> None:
        self.data.release()


def run_slow_resolution(issues: DataFrame, models: list[str] | None = None, parity: bool = False) -> SlowResolution:
    """Model comparison, confusion cells, permutation importance of the best model and coefficient shares."""
    spark = issues.sparkSession
    data = slow_datasets(issues, parity)
    results = train_slow_models(data, models)
    best = best_model(results)
    tables = {
        "model_comparison": model_comparison(spark, results),
        "confusion": confusion_table(tagged_predictions(results, data.test)),
        "permutation_importance": permutation_importance(
            best.model, data.pipeline, data.test.drop("features"), SLOW_COLUMNS
        ),
    }
    for result in results:
        if result.name == "LogReg":
            inputs = [f"{name}_vec" for name in SLOW_COLUMNS]
            tables["coefficient_importance"] = grouped_coef_importance(result.model, data.train, inputs)
    return SlowResolution(tables, data)
