"""Size of the batches that tasks hand to Python."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ticketscope.llm import linededup, quality, simhash
from ticketscope.llm.batches import BATCH_BYTES, mapped

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def session(spark):
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "64m")
    yield spark
    spark.conf.set(LIMIT, before)


def sizes(texts):
    """Rows and bytes of every batch."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (batch.num_rows, batch.nbytes)], names=["rows", "bytes"])

    return mapped(texts, run, "rows long, bytes long").collect()


def test_batches_are_bounded_and_whole(session):
    texts = session.range(0, 3000, 1, 1).select(F.repeat(F.lit("word "), F.when(F.col("id") == 7, 2_000_000).otherwise(1000).cast("int")).alias("text"))
    found = sizes(texts)
    assert sum(r.rows for r in found) == 3000 and sum(r.bytes for r in found) > 24_000_000
    long = [r for r in found if r.bytes > BATCH_BYTES + 10_000]
    assert len(long) == 1 and long[0].rows == 8  # the row that passes the bound ends the batch


def test_a_lower_bound_stays(session):
    session.conf.set(LIMIT, "64k")
    texts = session.range(0, 300, 1, 1).select(F.repeat(F.lit("word "), 1000).alias("text"))
    assert all(r.bytes <= 80_000 for r in sizes(texts))
    assert session.conf.get(LIMIT) == "64k"


@pytest.mark.parametrize("operator", [quality.fitted, quality.keep_good, lambda docs: quality.measure(docs, ["doc_id"]), simhash.with_fingerprint, linededup.keep_unique])
def test_operators_take_bounded_batches(session, operator):
    operator(session.createDataFrame([(1, "a line of words\nand another one")], "doc_id long, text string"))
    assert int(session.conf.get(LIMIT)) == BATCH_BYTES
