"""Pages from a range index against sorting and skipping everything."""

import random

import pytest

from tidelog.errors import TidelogError
from tidelog.operators import tables as tb


@pytest.mark.parametrize("sort,descending", [(None, False), ("title", True), ("created_at", False)])
def test_every_page_is_that_of_offset(spark, sort, descending):
    r = random.Random(3)
    rows = [(i, r.choice([None, "a", "b", f"t{i}"]), r.choice([None, f"2026-01-{i % 28 + 1:02d}"])) for i in range(230)]
    frame = spark.createDataFrame(rows, "id long, title string, start_ts string").repartition(3)
    pages = tb.Pages(frame, sort, descending, range_rows=40)
    assert pages.total == 230 and len(pages.ranges) > 3
    whole = [x.id for x in frame.orderBy(*tb._page_order(sort, descending)).collect()]
    for offset in range(0, 280, 30):
        got, env = pages.page(30, offset)
        assert [x.id for x in got.collect()] == whole[offset : offset + 30]
        assert env == {"total": 230, "limit": 30, "offset": offset, "has_next": offset + 30 < 230, "has_prev": offset > 0}
        assert len({f.rsplit("/", 2)[1] for f in got.inputFiles()}) <= 2


def test_pages_of_nothing_and_wrong_ones(spark):
    none = tb.Pages(spark.createDataFrame([], "id long, title string, start_ts string"))
    assert none.page(10, 0)[0].collect() == [] and none.page(10, 20)[1]["has_prev"]
    for bad in ((0, 0), (101, 0), (10, -1)):
        with pytest.raises(TidelogError, match="INVALID_PAGINATION"):
            none.page(*bad)
    with pytest.raises(TidelogError, match="INVALID_PAGINATION"):
        tb.Pages(spark.createDataFrame([], "id long"), "color")
