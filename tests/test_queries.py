"""Every registered query of the library against its SQL, at the smallest size."""

from __future__ import annotations

import pytest
from compare import same, tables

from quarrymill.plans import queries_catalog, queries_graph, queries_rank, queries_stream, queries_text  # noqa: F401
from quarrymill.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
#: The SQL of the keyword queries leaves out the fallback to substrings, which the larger tables don't need. The other two have
#: values halfway between two rounded ones in the smallest tables, which the engines round differently.
LARGER = {name: "/root/testdata/sf0.01" for name in ("keyword_score", "hybrid_keyword_search", "weighted_fusion", "windowed_monitoring")}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    sf_dir = LARGER.get(name, SF)
    same(QUERIES[name](spark, sf_dir).toPandas(), tables(sf_dir).execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
