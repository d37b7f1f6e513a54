"""Every query of the training-data problems on odd tables."""

import pytest

from edges import SOURCE, VARIANTS, variant
from lacuna.llm import queries

pytestmark = pytest.mark.skipif(not SOURCE.exists(), reason="no test tables")
#: Reports that name every listed source even where there is nothing to draw.
REPORTS = {"p9_shares", "p6_loadings"}


@pytest.mark.parametrize("name", list(queries.QUERIES))
@pytest.mark.parametrize("kind", VARIANTS)
def test_odd_tables(spark, tmp_path_factory, kind, name):
    folder = variant(kind, tmp_path_factory.mktemp(kind))
    plain = queries.QUERIES[name](spark, str(SOURCE))
    out = queries.QUERIES[name](spark, folder)
    assert out.columns == plain.columns
    n = len(out.collect())
    if kind == "empty" and name not in REPORTS:
        assert n == 0
    if kind == "clashing":
        assert n == plain.count()
