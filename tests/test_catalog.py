import pytest

from lensframe.plans import catalog, catalog_files, catalog_io, catalog_merge, catalog_more, catalog_scene
from tests.compare import SF, connection, same

Q = {**catalog.QUERIES, **catalog_scene.QUERIES, **catalog_io.QUERIES, **catalog_more.QUERIES, **catalog_merge.QUERIES, **catalog_files.QUERIES}
S = {**catalog.ORACLE_SQL, **catalog_scene.ORACLE_SQL, **catalog_io.ORACLE_SQL, **catalog_more.ORACLE_SQL, **catalog_merge.ORACLE_SQL, **catalog_files.ORACLE_SQL}


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", sorted(S))
def test_equals_sql(spark, con, name):
    same(Q[name](spark, SF), S[name], con)


@pytest.mark.parametrize("name", sorted(set(Q) - set(S)))
def test_runs(spark, name):
    assert Q[name](spark, SF).count() > 0
