import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import pytest  # noqa: E402
from oracle import compare, connect  # noqa: E402

from strandloom.llm import queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    compare(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])
