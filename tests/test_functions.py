import datetime

from pyspark.sql import functions as F

from millrace.functions import dates, money, text
from millrace.operators import ladder, merge, stats
from millrace.sources import readers


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def day(x):
    return F.lit(x).cast("date")


def test_string_hash_is_over_utf16_units(spark):
    def brute(s):
        h = 0
        units = s.encode("utf-16-be")
        for i in range(0, len(units), 2):
            h = (h * 31 + int.from_bytes(units[i : i + 2], "big")) & 0xFFFFFFFF
        return h - (1 << 32) if h >= 1 << 31 else h

    words = ["", "a", "물리치료사", "x😀y", "long " * 40]
    assert one(spark, *[text.string_hash(F.lit(w)) for w in words]) == tuple(map(brute, words))


def test_url_keys(spark):
    same = ["https://www.Example.com:443/a/?b=1#x", "http://example.com/a/?b=1"]
    a, b, c = one(spark, *[text.url_key(F.lit(u)) for u in [*same, " no url "]])
    assert a == b == "example.com/a/?b=1" and c == "no url"
    assert one(spark, text.without_session(F.lit("http://a/b;jsessionid=1F?x=1&utm_source=q&y=2")))[0] == "http://a/b?x=1&y=2"


def test_tags_with_other_names_stay(spark):
    assert one(spark, text.strip_tags(F.lit("<b>모집</b> <물리치료사> 1 < 2")))[0] == "모집 <물리치료사> 1 < 2"


def test_redaction_comes_before_the_cut(spark):
    assert one(spark, text.redact(F.lit("mail to ann@example.org now"), 12))[0] == "mail to [mai"


def test_numbers(spark):
    got = one(spark, text.loose_int(F.lit("3명")), text.strict_int(F.lit("3명")), text.strict_int(F.lit("1,200")), text.loose_int(F.lit("x")))
    assert got == (3, None, 1200, None)


def test_dates(spark):
    lenient = [dates.lenient_date(F.lit(x)) for x in ("2026.2.30", "20260102", "2026-13-01", "x")]
    assert one(spark, *lenient) == ("2026-02-30", "2026-01-02", None, None)
    assert one(spark, dates.strict_date(F.lit("2026.2.30")))[0] is None
    today = day("2026-03-31")
    closed = [dates.is_closed(d, today) for d in (F.lit(None).cast("date"), day("2026-03-30"), today)]
    assert one(spark, *closed) == (False, True, False)
    assert one(spark, dates.is_closed(today, today, F.lit("18:00"), F.lit("18:01")), dates.is_closed(today, today, F.lit("18:00"), F.lit("18:00"))) == (True, False)
    assert one(spark, dates.months_between_floor(day("2026-01-31"), day("2026-02-28")), dates.months_ago(today, 1)) == (0, datetime.date(2026, 2, 28))
    label = F.lit("rolling")
    badges = [dates.deadline_badge(day(x), today, l) for x, l in (("2026-03-30", label), ("2026-04-01", label), ("2026-03-31", None), ("2026-04-02", None))]
    assert one(spark, *badges) == ("closed", "rolling", "today", "D-2")


def test_money(spark):
    got = one(
        spark,
        money.half_up(F.lit(-2.5)),
        money.floor_to(F.lit(1239.6), 10),
        money.annual_leave(F.lit(300), F.lit(10)),
        money.annual_leave(F.lit(1200), F.lit(40)),
        money.annual_leave(F.lit(12000), F.lit(400)),
        money.severance(F.lit(100.0), F.lit(364)),
    )
    assert got == (-2, 1240, 10, 16, 25, 0)
    gross = money.gross_from_net(F.lit(90.0), lambda g: g * 0.9, F.lit(1000))
    assert abs(one(spark, gross)[0] - 100) < 1e-6


def test_a_missing_owner_takes_nothing(spark):
    old = spark.createDataFrame([(1, None, "a", None), (2, "A", "a", ["v"]), (3, "B", "a", None), (4, "A", "a", None)], "id int, source string, v string, edited_fields array<string>")
    new = spark.createDataFrame([(i, "A", "b") for i in (1, 2, 3, 4, 5)], "id int, source string, v string")
    out = {r.id: (r.source, r.v, r.outcome) for r in merge.ownership_merge(old, new, merge.Ownership("id", owned=("v",))).collect()}
    assert out == {1: (None, "a", "updated"), 2: ("A", "a", "updated"), 3: ("B", "a", "refused"), 4: ("A", "b", "updated"), 5: ("A", "b", "inserted")}


def test_null_conditions_do_not_hold(spark):
    df = spark.createDataFrame([(None,), (1,)], "x int")
    out = ladder.ladder(df, [ladder.Rule(F.col("x") > 0, "yes", "one")], ("no", "none"))
    assert {(r.x, r.verdict) for r in out.collect()} == {(None, "no"), (1, "yes")}
    assert [r.reason for r in ladder.quarantine(df, [("x", F.col("x") > 0)]).orderBy("x").collect()] == ["x", None]


def test_small_groups_are_hidden(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, v double")
    out = {r.g: (r.n, r.median) for r in stats.five_numbers(df, ["g"], "v", 2).collect()}
    assert out == {"a": (2, 2.0), "b": (1, None)}


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿h1,h2\n"x, ""y""\nz",1\n,2\n', encoding="utf-8")
    assert [tuple(r) for r in readers.positional_csv(spark, str(tmp_path / "a.csv"), ["name", "n"], "name").collect()] == [('x, "y"\nz', "1")]
    (tmp_path / "a.json").write_text('{"version": 1, "rows": [{"a": 1}, {"a": null}]}')
    assert [r.a for r in readers.json_rows(spark, str(tmp_path / "a.json"), "rows", "a: int").collect()] == [1, None]
    (tmp_path / "a.xml").write_text("<r><item><a>1</a></item><item><b>2</b></item></r>")
    assert [tuple(r) for r in readers.xml_items(spark, str(tmp_path / "a.xml"), "item", "a string, b string").collect()] == [("1", ""), ("", "2")]
    page = '<li><a href="/1">Nurse wanted</a> 2026-01-01 ~ 2026-01-31</li><li><a href="/2">abc</a> 2026-02-01</li><li><a href="/3">Therapist</a> 2026-02-01</li>'
    rows = readers.html_rows(
        spark.createDataFrame([("u", page)], "url string, html string"),
        {"row": "<li>.*?</li>", "title": ">([^<]+)</a>", "link": 'href="([^"]+)"', "date": "([0-9]{4}-[0-9]{2}-[0-9]{2})"},
    )
    assert [tuple(r)[1:] for r in rows.collect()] == [
        ("Nurse wanted", "/1", "2026-01-01", "2026-01-31", None),
        ("Therapist", "/3", None, None, "2026-02-01"),
    ]


def test_merging_sink_is_idempotent(spark, tmp_path):
    from millrace.streaming import jobs

    schema = "id int, source string, v string, edited_fields array<string>"
    sink = jobs.merging_sink(str(tmp_path), merge.Ownership("id", owned=("v",)))
    sink(spark.createDataFrame([(1, "A", "a", None)], schema), 0)
    for _ in range(2):
        sink(spark.createDataFrame([(1, "A", "b", None), (2, "A", "c", None)], schema), 1)
    assert sorted((r.id, r.v) for r in spark.read.parquet(f"{tmp_path}/v1").collect()) == [(1, "b"), (2, "c")]


def test_rows_without_a_value_have_no_rank(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "b", 3.0), (4, "b", None), (5, "a", 3.0), (6, "a", 2.0)], "id long, g string, v double")
    got = {r.id: (r.rank_all, r.rank_within) for r in stats.ranked(df, "v", "g").collect()}
    assert got == {1: (4, 3), 2: (None, None), 3: (1, 1), 4: (None, None), 5: (1, 1), 6: (3, 2)}
    assert {r.v: r.below for r in stats.counts_below(df, "v").collect()} == {1.0: 0, 2.0: 1, 3.0: 2}
    nothing = df.filter("v is null")
    assert [r.rank_all for r in stats.ranked(nothing, "v", "g").collect()] == [None, None]
