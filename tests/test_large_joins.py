"""Tables that are few bytes and many rows are joined by shuffle: broadcast, they would fill the driver."""

import pytest

from docframe.operators import inheritance as I
from docframe.operators import parts as P
from docframe.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["list_levels", "workbook_styles", "word_themes", "slide_themes", "sheet_themes", "workbook_themes"])
def test_no_broadcast_beyond_the_count(spark, monkeypatch, name):
    """Counted tables over the bound are shuffled, and so is what is joined before it is counted, though a few kilobytes."""
    for module in (P, I):
        monkeypatch.setattr(module, "written", lambda df: df)
    monkeypatch.setattr(P, "MOST_BROADCAST", -1)
    assert "BroadcastExchange" not in QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_small_lookups_are_broadcast(spark):
    assert "BroadcastExchange" in QUERIES["list_levels"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
