import duckdb
import pytest

from mailsift.llm.oracle import ORACLE
from mailsift.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_duckdb(spark, name, folder):
    sf_dir = f"/root/testdata/{folder}"
    duck = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    ours = QUERIES[name](spark, sf_dir)
    result = duck.execute(ORACLE[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(ours.columns)
    assert sorted(map(tuple, ours.select(*names).collect())) == sorted(result.fetchall())
