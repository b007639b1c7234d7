from pyspark.sql import functions as F

from millrace.functions import labels
from millrace.sources import pages


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_dictionaries_and_tags(spark):
    assert one(spark, labels.longest_hit(F.lit("서울특별시 강남"), ["서울", "서울특별시"]), labels.longest_hit(F.lit("x"), ["a.b"])) == ("서울특별시", None)
    tags = F.array(*map(F.lit, ["b", "full", "a", "x"]))
    assert one(spark, *labels.partition_tags(tags, ["a", "b"], ["full"])) == (["b", "a"], ["full"], ["x"])
    assert one(spark, *labels.decoded(F.lit("1"), {"1": "one"}), *labels.decoded(F.lit("9"), {"1": "one"})) == ("one", True, "9", False)
    assert one(spark, labels.only_one(F.array(F.lit("a"), F.lit(None), F.lit("a"))), labels.only_one(F.array(F.lit("a"), F.lit("b")))) == ("a", None)


def test_required_and_preferred(spark):
    must, may = labels.required_and_preferred(F.lit("필수: 면허, 경력 2년 우대, 차량 / 우대: 영어, 일어 ; required: shift"))
    assert one(spark, must, may) == (["면허", "차량", "shift"], ["경력 2년", "영어", "일어"])


def test_brackets_keep_commas(spark):
    assert one(spark, labels.split_outside_brackets(F.lit("a (b, c), d[e,f] ,g")))[0] == ["a (b, c)", "d[e,f]", "g"]


def test_pay_texts(spark):
    texts = ["월 200~250만원", "연봉 3,600만원", "시급 11000", "2,500,000원", "협의"]
    got = [None if r is None else tuple(r) for r in one(spark, *[labels.pay_range(F.lit(t)) for t in texts])]
    assert got == [(2_000_000, 2_500_000, "month"), (36_000_000, 36_000_000, "year"), None, (2_500_000, 2_500_000, "month"), None]


def test_survey_rows(spark):
    n, x = F.lit(None).cast("int"), F.lit(1)
    assert one(spark, *[labels.complete_or_empty(c) for c in ([n, n], [x, x], [x, n])]) == (True, True, False)


def test_list_pages(spark):
    html = '<p>총 <b>1,234</b>건</p><a href="/l?page=2&x=1">2</a><a href="/l?page=3">3</a><a href="/l?sort=1">s</a>'
    df = spark.createDataFrame([("u", html)], "url string, html string")
    assert df.select(pages.declared_total(F.col("html"))).first()[0] == 1234
    assert [tuple(r) for r in pages.paging_parameter(df).collect()] == [("u", "page", 2)]


def test_robots(spark):
    text = F.lit("User-agent: a\nUser-agent: *\nDisallow: /x\nAllow: /x/open # yes\n\nUser-agent: b\nDisallow: /")
    rules = pages.robots_rules(text)
    assert one(spark, *[pages.robots_allow(rules, F.lit(p)) for p in ("/x/1", "/x/open/2", "/y")]) == (False, True, True)
