"""Every query of the general problems on odd tables."""

import pytest

from edges import SOURCE, VARIANTS, variant
from lacuna.plans import quality

pytestmark = pytest.mark.skipif(not SOURCE.exists(), reason="no test tables")

#: Tables whose columns are the fields found in the data.
BY_DATA = {"p2_hibou", "p2_midnight", "p2_phikon"}


@pytest.fixture(scope="module")
def plain(spark):
    return {n: quality.QUERIES[n](spark, str(SOURCE)) for n in quality.QUERIES}


@pytest.mark.parametrize("name", list(quality.QUERIES))
@pytest.mark.parametrize("kind", VARIANTS)
def test_odd_tables(spark, plain, tmp_path_factory, kind, name):
    folder = variant(kind, tmp_path_factory.mktemp(kind))
    out = quality.QUERIES[name](spark, folder)
    if not (kind == "empty" and name in BY_DATA):
        assert out.columns == plain[name].columns
    n = len(out.collect())
    if kind == "empty":
        assert n == 0
    if kind == "clashing":
        assert n == plain[name].count()
