"""Every registered query against its SQL in DuckDB."""

import pandas as pd
import pytest

from gaugeline.plans import catalogue, columns, designs, inference, studies  # noqa: F401  (registers its queries)
from tests.conftest import SMALL


def rows(df: pd.DataFrame):
    def plain(v):
        return None if v is None or v is pd.NA or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) or getattr(getattr(v, "dtype", None), "kind", "") in ("i", "f", "u") else str(v)

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL).toPandas()
    want = duck.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, abs=2e-4) if all(isinstance(v, float) for v in x) else [pytest.approx(v, abs=2e-4) if isinstance(v, float) else v for v in y] == list(x)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
