"""People ranked by profiles of needs, against pairs of all people and projects."""

import re

import pytest

from lodestar.operators import flagship
from lodestar.plans.staffing import ranked_project

DATA = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("at_once", [(1 << 16, 10_000), (40, 2)])
def test_as_all_pairs(spark, monkeypatch, at_once):
    monkeypatch.setattr(flagship, "MOST_FACTS", 1)
    want = rows(ranked_project(spark, DATA))
    monkeypatch.undo()
    monkeypatch.setattr(flagship, "PEOPLE_AT_ONCE", at_once[0])
    monkeypatch.setattr(flagship, "PROJECTS_AT_ONCE", at_once[1])
    assert rows(ranked_project(spark, DATA)) == want
    assert want


def test_no_row_for_a_pair(spark):
    plan = ranked_project(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[id#\d+L?, project#", plan)


@pytest.mark.parametrize("at_once", [(400_000, 100_000), (300, 3)])
def test_best_both_ways_as_all_pairs(spark, monkeypatch, at_once):
    from lodestar.operators import shown
    from lodestar.plans.jobs import best_both_ways

    monkeypatch.setattr(flagship, "MOST_FACTS", 1)
    want = rows(best_both_ways(spark, DATA))
    monkeypatch.undo()
    monkeypatch.setattr(shown, "ROWS_AT_ONCE", at_once[0])
    monkeypatch.setattr(shown, "PROJECTS_AT_ONCE", at_once[1])
    got = best_both_ways(spark, DATA)
    assert rows(got) == want
    assert want
    # No row for a pair of a person and a project is made.
    assert "FlatMapCoGroupsInPandas" in got._jdf.queryExecution().optimizedPlan().toString()
