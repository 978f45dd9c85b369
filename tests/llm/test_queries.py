"""Registered queries against their SQL, and that each one is registered once."""

import re
import sys
from pathlib import Path

import pytest
from fixtures import SMALL

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from compare import database, differences  # noqa: E402

from ticketscope.llm.oracles import ORACLES  # noqa: E402
from ticketscope.llm.queries import QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SMALL), database(SMALL), ORACLES[name]) is None


def test_each_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))
