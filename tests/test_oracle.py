"""Every registered market query against its SQL."""

import pytest

from quantloom.plans import catalogue
from tests.compare import assert_same

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, name):
    assert_same(catalogue.QUERIES[name](spark, DATA), catalogue.ORACLES[name], DATA)


def test_every_query_has_sql_or_says_why_not():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"x4_macro_factor_pca"}  # an iterative decomposition


def test_principal_component_is_centred_and_signed(spark):
    rows = catalogue.QUERIES["x4_macro_factor_pca"](spark, DATA).collect()
    assert rows and abs(sum(r["macro_factor"] for r in rows)) / len(rows) < 1e-4


def test_principal_component_by_decomposition(spark):
    import numpy as np

    from quantloom.operators import fusion

    macro, ids = catalogue.Tables(spark, DATA).macro_data, catalogue.IDS
    z = np.array([[r[c] for c in ids] for r in fusion.z_scores(macro, ids, 20).orderBy("trade_date").collect()])
    centred = z - z.mean(axis=0)
    loading = np.linalg.svd(centred, full_matrices=False)[2][0]
    loading = loading * np.sign(loading[np.abs(loading).argmax()])
    got = [r["macro_factor"] for r in fusion.macro_factor_pca(macro, ids).orderBy("trade_date").collect()]
    assert len(got) > 5 and np.allclose(got, centred @ loading, atol=1e-8)
