"""Every registered query against its SQL twin, and the driver contract."""

import os

import pytest

import __spark_entry__ as contract
from fleetgauge.catalog import load
from tests.oracle import compare, connect

REGISTRY = load()
# Fits need both classes in every split; the smallest tables do not offer that.
FITTED_FACTS = ["m1_test_windows", "m1_prefix_is_refit", "m3_scores_in_unit", "m5_search_covers_all", "m5_halving_rounds", "m6_families_tested", "m7_importance_sums",
                "m8_saved_scores_same", "m9_contributions_add_up"]
NEEDS_MORE_ROWS = [n for n in REGISTRY if n[0] == "m" and REGISTRY[n].sql is None or n.startswith(("plan_", "e35")) or n in FITTED_FACTS]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n in REGISTRY if n not in NEEDS_MORE_ROWS])
def test_query_matches_sql(spark, con, sf_dir, name):
    problem = compare(spark, con, sf_dir, REGISTRY[name])
    assert problem in (None, "EMPTY"), problem


@pytest.mark.parametrize("name", ["m1_boosted_trees", "m9_contributions"])
def test_model_queries_run(spark, name):
    assert REGISTRY[name].build(spark, "/root/testdata/sf0.01").count() > 0


@pytest.mark.parametrize("name", FITTED_FACTS)
def test_fitted_models_match_sql(spark, name):
    more = "/root/testdata/sf0.01"
    assert compare(spark, connect(more), more, REGISTRY[name]) is None


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["k", "k_effective", "hits", "precision", "recall", "best_possible", "lift"]
    assert df.count() == 4


def test_twins_name_registered_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 150


def test_import_needs_no_session():
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(contract.__file__))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.oracle_sql()"], cwd=root, check=True)
