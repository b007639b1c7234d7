"""The table function over list pages: columns by name, missing parts, nulls, and what it refuses."""

import pytest

from millrace.sources import tables

PARTS = {"title": "<b>([^<]*)</b>", "day": "([0-9]{4}-[0-9]{2})"}


def test_rows_by_the_patterns_of_a_site(spark):
    rows = [(1, "a", "<li><b>x</b> 2024-01</li>\n<li>\n<b>y</b></li>"), (2, "a", None), (3, "b", "<li><b>z</b></li>"), (4, "a", ""), (5, "c", "<li>"), (6, None, "<li></li>")]
    sites = spark.createDataFrame([("a", "<li>.*?</li>", PARTS), ("b", "<li>.*?</li>", None), ("c", None, PARTS)], "site string, row string, parts map<string,string>")
    pages = spark.createDataFrame(rows, "id long, site string, html string")
    out = tables.board_rows(pages, sites, "site", "title,day,other")
    assert out.columns == ["id", "site", "place", "title", "day", "other"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", 1, "x", "2024-01", None), (1, "a", 2, "y", None, None), (3, "b", 1, None, None, None)]
    assert tables.board_rows(pages.limit(0), sites, "site", "title").count() == 0


def test_what_is_refused(spark):
    tables.register(spark)
    for bad in ("'<li>', map('a', 'b'), concat('a', uuid())", "'<li>', 'no map', 'title'", "'<li>', map('a', 'b'), ''"):
        with pytest.raises(Exception, match="have to be"):
            spark.sql(f"SELECT * FROM board_rows('<li>', {bad})").collect()
