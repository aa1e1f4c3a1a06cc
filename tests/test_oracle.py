from functools import partial

import duckdb
import pytest
from pyspark.sql import functions as F

from mailsift import queries
from mailsift.operators.models import TrainingOptions
from mailsift.oracle import ORACLE
from mailsift.queries import QUERIES

TABLES = ["documents", "pages", "conversations", "benchmark"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


@pytest.fixture(scope="module", autouse=True)
def few_rounds():
    """The model queries' checks hold for any models, so tests train smaller ones."""
    with pytest.MonkeyPatch.context() as patch:
        small = TrainingOptions(trees=8, forest_depth=8, rounds=4, boosting_depth=4)
        patch.setattr(queries.training, "train", partial(queries.training.train, options=small))
        yield
        queries._trained.clear()


def shown(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return repr(value)
    return repr(round(float(value), 9) + 0.0)


def test_oracle_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_duckdb(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted(tuple(map(shown, r)) for r in df.select(*[F.col(f"`{c}`") for c in names]).collect())
    result = duck.execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    theirs = sorted(tuple(shown(r[i]) for i in order) for r in result.fetchall())
    assert ours == theirs
