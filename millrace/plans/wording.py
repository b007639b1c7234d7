"""Markup, names, regions and lists in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.plans.registry import query, table


def chosen(values, key: Column) -> Column:
    """The element of a list at ``key`` modulo its length."""
    return F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))


def chosen_sql(values, key: str) -> str:
    """The same in SQL."""
    listed = ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in values)
    return f"([{listed}])[CAST({key} % {len(values)} AS INTEGER) + 1]"


ENCODED = ("a &amp;amp; b", "&lt;p&gt;", "&#65;&#x42; &amp;#67;", "&amp;amp;amp;amp;amp;amp;amp;lt;", "plain", "&#128512; &#xAC00;", "&#1114112; &nbsp;x", "&amp;quot;q&apos;")
DECODED = ("a & b", "<p>", "AB C", "&amp;amp;lt;", "plain", "😀 가", "&#1114112;  x", "\"q'")


@query(f"SELECT p_partkey, {chosen_sql(DECODED, 'p_partkey')} AS decoded FROM part")
def decoded_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character references decoded until nothing changes, five times at most."""
    return table(spark, sf_dir, "part").select("p_partkey", text.decode_all(chosen(ENCODED, F.col("p_partkey"))).alias("decoded"))


@query(
    r"""
    WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->', ' ', 'g') AS t FROM pages),
    b AS (SELECT page_id, regexp_replace(regexp_replace(t, '[\t\n\r\x0B\f]+', ' ', 'g'), '(?i)</?(?:p|div|br|li|tr|h[1-6]|table|ul|ol|section|article|header|footer|dd|dt)(?:\s[^>]*)?/?>', chr(10), 'g') AS t FROM a),
    c AS (SELECT page_id, regexp_replace(regexp_replace(t, '</?[A-Za-z][^>]*>|<!--[^>]*-->', '', 'g'), '[\x00-\x09\x0B-\x1F\x7F]', '', 'g') AS t FROM b),
    d AS (SELECT page_id, replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), chr(160), ' ') AS t FROM c)
    SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, ' +', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS text_md5
    FROM d
    """
)
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of pages with its lines."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.html_to_text(F.col("html"))).alias("text_md5"))


OFFICES = ("서울특별시 종로구", "전라북도 전주시", "전남광주통합특별시 광산구", "고용노동부", "보건복지부 산하", "충청남도 천안시", "알 수 없음", "강원특별자치도", None)
OFFICE_OF = ("서울", "전북", "전남광주", "전국", "전국", "충남", "모름", "강원", "모름")
REGIONS = ("서울특별시  강남구, 경기도 성남시", "전남광주통합특별시 광산구", "전남광주 순천시", "충청북도청주시", "세종특별자치시 조치원읍", " ,제주특별자치도 제주시,", "화성시 만세구", None)
REGION_TEXTS = ("서울 강남구, 경기 성남시", "광주 광산구", "전남 순천시", "충북 청주시", "세종 조치원읍", "제주 제주시", "화성시 만세구", "")
ADDRESSES = ("서울특별시 종로구 청운동 1", "경기도  성남시 분당구", "세종특별자치시 한누리대로", "부산광역시", "  ", None)
DISTRICTS = ("종로구", "성남시", None, None, None, None)
SECOND_WORDS = ("종로구", "성남시", "한누리대로", None, None, None)


@query(
    f"""
    SELECT p_partkey, {chosen_sql(OFFICE_OF, 'p_partkey')} AS province, {chosen_sql(REGION_TEXTS, 'p_partkey')} AS regions,
           {chosen_sql(SECOND_WORDS, 'p_partkey')} AS second_word, {chosen_sql(DISTRICTS, 'p_partkey')} AS district
    FROM part
    """
)
def regions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provinces of offices, regions in their short form, districts of addresses."""
    k = F.col("p_partkey")
    _, second, district = text.address_parts(chosen(ADDRESSES, k))
    office = F.coalesce(chosen(OFFICES, k), F.lit(""))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        text.province_of(office).alias("province"),
        text.region_text(chosen(REGIONS, k)).alias("regions"),
        second.alias("second_word"),
        district.alias("district"),
    )


NAMES = ("의료법인 인당의료재단 부민병원", "주식회사 더 행복", "(주)강원랜드", "(주)이지", "삼성(杉晟)센텀정형외과의원", "계양효(孝)요양원", "㈜한빛★재활", None)
SHOWN = ("인당의료재단 부민병원", "더 행복", "강원랜드", "(주)이지", "삼성센텀정형외과의원", "계양효요양원", "한빛 재활", "")
TAGS = ("#인당의료재단부민병원", "#더행복", "#강원랜드", "#이지", "#삼성센텀정형외과의원", "#계양효요양원", "#한빛재활", "#")


@query(
    f"""
    SELECT o_orderkey, {chosen_sql(SHOWN, 'o_orderkey')} AS shown, {chosen_sql(TAGS, 'o_orderkey')} AS tag,
           CASE WHEN o_orderkey % 5 = 0 THEN 'AL' WHEN o_orderkey % 5 = 1 THEN 'WN' WHEN o_orderkey % 5 = 2 THEN 'HS' WHEN o_orderkey % 5 = 3 THEN 'GJ' ELSE 'X' END AS source
    FROM orders
    """
)
def names_and_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they are shown and as tags, and sources by the beginning of an id."""
    k = F.col("o_orderkey")
    key = F.concat(chosen(("", "WNKF", "hs", "GJX", "x"), k), k.cast("string"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.shown_name(chosen(NAMES, k)).alias("shown"), text.hashtag(chosen(NAMES, k)).alias("tag"), text.source_of(key).alias("source")
    )


LISTS = ("가, 나(다, 라), 마", "물리치료사(1급, [2급, 3급]), 작업치료사", ",,", "하나", "a(b, c", "x), y")
PARTS = ("가|나(다, 라)|마", "물리치료사(1급, [2급, 3급])|작업치료사", "", "하나", "a(b, c", "x)|y")
BRACKETED = (None, "1급, [2급, 3급]", None, None, None, None)
SPEECH = ("One. Two! Three? four", "No end", "A.B. C.", "끝났다. 다음!  마지막", "", "...")
N_SPEECH = (4, 1, 2, 3, 0, 1)


@query(
    f"""
    SELECT p_partkey, {chosen_sql(PARTS, 'p_partkey')} AS parts, {chosen_sql(BRACKETED, 'p_partkey')} AS listed,
           CAST({chosen_sql(N_SPEECH, 'p_partkey')} AS BIGINT) AS n_sentences,
           array_to_string(list_filter(w, lambda x: len(list_filter(w, lambda y: y <> x AND contains(y, x))) = 0), '|') AS longest
    FROM (SELECT *, list_filter(v, lambda x, i: NOT list_contains(v[1 : i - 1], x)) AS w FROM (SELECT *, string_split(p_name || ' ' || substr(p_name, 1, 3), ' ') AS v FROM part))
    """
)
def lists_in_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists with brackets, brackets that list several things, sentences, elements that are part of others."""
    k = F.col("p_partkey")
    words = F.split(F.concat("p_name", F.lit(" "), F.substring("p_name", 1, 3)), " ")
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.array_join(text.split_outside_brackets(chosen(LISTS, k)), "|").alias("parts"),
        text.listed_in_brackets(chosen(LISTS, k)).alias("listed"),
        F.size(text.sentences(chosen(SPEECH, k))).cast("long").alias("n_sentences"),
        F.array_join(text.without_parts(words), "|").alias("longest"),
    )


PAGE_TITLES = ("Login", "Just a moment...", "404 Not Found", "Jobs", "Login", "News")
PAGE_TEXTS = ("", "", "", "Fatal error: x in y on line 7", "", "SQLSTATE[42000]: bad")


@query(
    """
    SELECT event_id, CASE event_id % 6 WHEN 0 THEN CASE WHEN event_id % 12 = 0 THEN 'login' END WHEN 1 THEN 'blocked' WHEN 2 THEN 'error' WHEN 3 THEN 'application trace'
             WHEN 4 THEN CASE WHEN event_id % 12 = 0 THEN 'login' END WHEN 5 THEN 'database trace' END AS signature
    FROM events
    """
)
def page_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of failure a page shows."""
    k = F.col("event_id")
    found = text.error_signature(chosen(PAGE_TITLES, k), chosen(PAGE_TEXTS, k), k % 12 == 0)
    return table(spark, sf_dir, "events").select("event_id", found.alias("signature"))
