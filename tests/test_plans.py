"""Plans keep what makes them scale: pushed filters, pruned columns, one shuffle by key, no cross joins."""

import re

import pytest

from cadence.plans.queries import QUERIES
from tests.conftest import SF


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_columns_are_pruned(spark):
    text = plan(QUERIES["weighted_class_rollup"](spark, SF))
    (schema,) = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert schema.count(":") == 4
    assert "props" not in plan(QUERIES["resample_pipeline"](spark, SF))


def test_filters_are_pushed(spark):
    assert "EqualTo(event_type,click)" in plan(QUERIES["interval_match_counts"](spark, SF))


@pytest.mark.parametrize(("name", "most"), [("hysteresis_count", 1), ("local_peaks", 1), ("activity_sessions", 2), ("gap_fill_linear", 2), ("rolling_quantiles", 1), ("hold_timer_replay", 1)])
def test_shuffles(spark, name, most):
    assert len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", plan(QUERIES[name](spark, SF)))) <= most


@pytest.mark.parametrize("name", ["near_duplicate_pairs", "interval_match_counts", "form_rule_eval"])
def test_no_cross_joins(spark, name):
    assert "CartesianProduct" not in plan(QUERIES[name](spark, SF)) and "NestedLoop" not in plan(QUERIES[name](spark, SF))


def test_label_sheet_reads_every_event(spark, monkeypatch):
    from cadence.plans import relational

    monkeypatch.setattr(relational.sheets, "label_problems", lambda sheet, manifest: sheet)
    sheet = relational.label_sheet_problems(spark, "/root/testdata/sf0.001")
    marks = sheet.selectExpr("sum(size(split(rep_timestamps_ms, ';')))").collect()[0][0]
    assert marks == relational.events(spark, "/root/testdata/sf0.001").where("event_type <> 'view'").count()
