import pytest

from extentlake.plans.queries import QUERIES, SQL

from .compare import same
from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    same(QUERIES[name](spark, SMALL), duck, SQL[name])


def test_row_proof(spark):
    import hashlib

    from extentlake.functions.binary import row_frame

    got = QUERIES["q75_row_proof"](spark, SMALL).collect()
    want = hashlib.sha256()
    for r in spark.read.parquet(f"{SMALL}/nation.parquet").orderBy("n_nationkey").collect():
        want.update(row_frame([r.n_nationkey, r.n_name, r.n_regionkey]))
    assert [(r.rows, r.sha256) for r in got] == [(25, want.hexdigest())]


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["source_type", "target_type", "status", "displacement", "width", "n"]
    assert df.limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
