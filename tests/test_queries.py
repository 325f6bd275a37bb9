"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

import check_oracle
from check_oracle import entry
from workload.oracle import ORACLE
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return check_oracle.connect(SF)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    ok, note = check_oracle.compare(spark, duck, SF, name)
    assert ok, note


def test_empty_completions_counts_words_once(spark):
    """The filter on the mask has the length as a column, not the count of words in its place."""
    found = QUERIES["empty_completions"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    kept = next(line for line in found.splitlines() if "Filter" in line and "completion_len" in line)
    assert "split" not in kept


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["sent_id", "fwd_idx", "adv_bleu", "adv_chrf", "advantage", "group_size"]
    assert result.count() > 0
