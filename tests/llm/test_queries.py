import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from oracle import check

from lexigrid.llm import queries as Q


@pytest.mark.parametrize("name", list(Q.SQL))
@pytest.mark.parametrize("sf", ["sf0.001"])
def test_against_sql(spark, name, sf):
    check(spark, Q.queries()[name], Q.SQL[name], f"/root/testdata/{sf}")


@pytest.mark.parametrize("name", [n for n in Q.queries() if n not in Q.SQL])
def test_rows(spark, name):
    d = "/root/testdata/sf0.001"
    want = spark.read.parquet(f"{d}/{'embeddings' if name.startswith('op8') else 'documents'}.parquet").count()
    assert Q.queries()[name](spark, d).count() == want or name == "pipeline"
