"""The three tracker reports over raw exports: recent resolution times, their averages, most changed fields."""

from pyspark.sql import DataFrame

from ticketscope.operators.cleaning import clean_changelog, clean_comments, clean_issues, enrich_issues
from ticketscope.operators.resolution import recent_resolution, resolution_by_priority_status, top_changed_fields
from ticketscope.sources.writers import write_cleaned, write_report


def run_activity_report(
    raw_issues: DataFrame, raw_comments: DataFrame, raw_changelog: DataFrame, as_of=None, out: str | None = None
) -> dict[str, DataFrame]:
    """Result tables by name; below `out`, when given, the issues go to parquet and the summaries to CSV."""
    changelog = clean_changelog(raw_changelog)
    issues = enrich_issues(clean_issues(raw_issues), clean_comments(raw_comments), changelog)
    recent = recent_resolution(issues, as_of)
    tables = {
        "recent_resolution": recent,
        "resolution_by_priority_status": resolution_by_priority_status(recent),
        "top_changed_fields": top_changed_fields(changelog),
    }
    if out is not None:
        write_cleaned(recent, f"{out}/recent_resolution")
        orders = {"resolution_by_priority_status": ["priority_name", "status_name"], "top_changed_fields": None}
        for name, order in orders.items():
            write_report(tables[name], f"{out}/{name}", order)
    return tables
