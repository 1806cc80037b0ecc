"""Every query against its SQL counterpart in a second engine."""

import math

import duckdb
import pytest

from offerscope.plans import catalog, oracle

from conftest import SF_DIR

TABLES = ("part", "customer", "orders", "events")
SQL = oracle.oracle_sql()
#: Rest on iterative fits or on the learning replay; compared with brute force in test_policies.
WITHOUT_SQL = {
    "arm_posterior",
    "replay_thompson",
    "replay_thompson_rounds",
    "prior_sweep",
    "calibration_deciles",
    "calibration_heldout",
    "response_regret",
    "online_posterior",
    "policy_summary",
    "best_offer_by_value",
    "recommend",
    "top3_offers",
    "recommended_share",
    "policy_regret",
    "value_projection",
    "top_weights",
    "weight_table",
    "example_customers",
}


@pytest.fixture(scope="module")
def second_engine():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return con


def close(left, right):
    if isinstance(left, float) or isinstance(right, float):
        if left is None or right is None:
            return left is right
        return math.isclose(left, right, rel_tol=0, abs_tol=2e-6)
    return left == right


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, campaign, second_engine):
    found = catalog.run(name, campaign)
    result = second_engine.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(found.columns) == sorted(columns)
    order = sorted(columns)
    # text and whole numbers first, so that rounding does not disturb the order
    key = lambda row: [repr(v) for v in row if not isinstance(v, float)] + [
        repr(round(v, 3)) for v in row if isinstance(v, float)
    ]
    left = sorted((tuple(r[c] for c in order) for r in found.collect()), key=key)
    right = sorted((tuple(r[columns.index(c)] for c in order) for r in result.fetchall()), key=key)
    assert len(left) == len(right)
    for a, b in zip(left, right):
        assert all(close(x, y) for x, y in zip(a, b)), (a, b)


def test_every_query_is_covered():
    assert set(catalog.queries()) - set(SQL) == WITHOUT_SQL
    assert not set(SQL) - set(catalog.queries())


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_runs(name, campaign):
    assert catalog.run(name, campaign).count() > 0
