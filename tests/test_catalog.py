import numpy as np
import pytest

from lumenframe.plans import catalog


def rows(df):
    df = df[sorted(df.columns)]
    plain = lambda v: tuple(np.asarray(v).tolist()) if isinstance(v, (list, np.ndarray)) else v.item() if isinstance(v, np.generic) else v
    return sorted(repr(tuple(map(plain, r))) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, sf, duck):
    got = catalog.queries()[name](spark, sf).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
