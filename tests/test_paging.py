"""Pages far down against a plain sort."""

import pytest
from helpers import dicts, frame, plan_of

from runledger.operators import paging

ROWS = [(n, None if n % 11 == 0 else "same" if n % 3 else f"v{n % 17}", n % 5) for n in range(1, 301)]


@pytest.fixture(scope="module")
def table(spark):
    return frame(spark, "id bigint, name string, rest int", *({"id": a, "name": b, "rest": c} for a, b, c in ROWS)).repartition(7)


@pytest.mark.parametrize("direction", ["asc", "desc"])
@pytest.mark.parametrize("page", [1, 2, 9, 30, 31, 90])
def test_a_deep_page_is_the_page_of_the_whole_order(table, direction, page):
    if direction == "asc":
        whole = sorted(ROWS, key=lambda row: (row[1] is None, row[1] or "", row[0]))
    else:
        names = sorted({row[1] for row in ROWS if row[1]}, reverse=True)
        whole = sorted(ROWS, key=lambda row: (-1 if row[1] is None else names.index(row[1]), row[0]))
    expected = [row[0] for row in whole[(page - 1) * 10 : page * 10]]
    for top_rows in (0, 10**9):
        found = dicts(paging.sort_page(table, "id", "name", direction, page, 10, top_rows=top_rows))
        assert [row["id"] for row in found] == expected
        assert {(row["id"], row["name"], row["rest"]) for row in found} <= set(ROWS)


def test_a_deep_page_opens_its_ranges_alone(spark, table):
    plan = plan_of(paging.sort_page(table, "id", None, None, 12, 10, top_rows=0))
    assert "PartitionFilters: [range" in plan or "range#" in plan.split("PartitionFilters")[1][:200]


def test_pages_of_nothing_and_by_the_key(spark, table):
    assert dicts(paging.sort_page(table.limit(0), "id", "name", "asc", 3, 10, top_rows=0)) == []
    assert [row["id"] for row in dicts(paging.sort_page(table, "id", None, None, 4, 5, top_rows=0))] == [16, 17, 18, 19, 20]
