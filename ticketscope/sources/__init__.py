"""Readers for raw CSV exports and cleaned parquet, and the writers for both."""

from ticketscope.sources.published import publish, published, read_published
from ticketscope.sources.readers import read_csv, read_parquet
from ticketscope.sources.shared import shared_dir, shared_path
from ticketscope.sources.writers import ingest_csv, write_cleaned, write_report

__all__ = [
    "ingest_csv", "publish", "published", "read_csv", "read_parquet", "read_published", "shared_dir", "shared_path",
    "write_cleaned", "write_report",
]
