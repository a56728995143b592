"""Every registered query against its SQL on the smallest data set."""

import compare
import pytest

from dossier.plans import catalog

catalog.load()


@pytest.fixture(scope="session")
def con(data_dir):
    return compare.connect(data_dir)


#: Nested or long flows; their steps are checked one by one.
ROWS_ONLY = {"analyze_documents", "analysis_stages", "rule_related_documents"}


def test_only_known_queries_lack_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == ROWS_ONLY


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - {"analysis_stages"}))
def test_query_equals_sql(spark, con, data_dir, name):
    assert compare.difference(spark, con, name, data_dir) is None
