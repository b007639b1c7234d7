"""Verdicts on postings: labelled titles, attachments, steps, workplaces, links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import labels, triage
from millrace.plans.registry import query, table
from millrace.plans.wording import chosen, chosen_sql

#: A triage of documents by what their first line and their text hold.
OF_DOCUMENTS = triage.Lists(
    confirmed=("andthe", "mentoi", "theand"),
    look_alikes=("ofthe", "queeau", "enen"),
    possible=("inthe", "heth", "ement", "enter"),
    others=("ieren", "schen", "with", "oiai", "tionin"),
    kept_hidden=("that", "von"),
    ended=r"was\s+the|ist\s+die",
    generic=r"\bis\s+[a-z]+|\bder\b",
)


def _held(text: str, words: tuple[str, ...]) -> str:
    return f"list_filter({list(words)}, lambda w: contains({text}, w))"


def _bare(text: str, words: tuple[str, ...]) -> str:
    for w in words:
        text = f"replace({text}, '{w}', '')"
    return text


_BLANK = "[ \\t\\n\\v\\f\\r\\x{a0}\\x{3000}\\x{feff}]+"


@query(
    rf"""
    WITH d AS (SELECT doc_id, coalesce(split_part(text, chr(10), 1), '') AS title, coalesce(text, '') AS body, doc_id % 11 = 0 AS job, CAST(doc_id % 4 AS INTEGER) AS a FROM documents),
    s AS (SELECT *, regexp_replace(title, '{_BLANK}', '', 'g') AS z, regexp_replace(body, '{_BLANK}', '', 'g') AS zbody FROM d),
    b AS (SELECT *, {_bare('z', OF_DOCUMENTS.look_alikes)} AS bare FROM s),
    h AS (SELECT *, {_held('z', OF_DOCUMENTS.look_alikes)} AS alike, {_held('bare', OF_DOCUMENTS.confirmed)} AS confirmed, {_held('bare', OF_DOCUMENTS.possible)} AS possible,
             {_held('bare', OF_DOCUMENTS.kept_hidden)} AS kept, {_held('z', OF_DOCUMENTS.others)} AS others, {_held('z', OF_DOCUMENTS.possible)} AS named,
             {_held('zbody', OF_DOCUMENTS.confirmed)} AS ours, {_held('body', OF_DOCUMENTS.others)} AS theirs,
             regexp_extract(title, '({OF_DOCUMENTS.ended})', 1) AS ended, regexp_extract(title, '({OF_DOCUMENTS.generic})', 1) AS generic,
             list_filter(regexp_extract_all(title, '[(（]([^)）]*)[)）]', 1), lambda x: length(regexp_replace(x, '[^,，]', '', 'g')) >= 2)[1] AS listed FROM b),
    w AS (SELECT *, CASE WHEN ended <> '' THEN 1 WHEN job THEN 2 WHEN a = 1 THEN 3 WHEN a > 1 AND len(ours) > 0 THEN 4 WHEN a > 1 THEN 5 WHEN len(confirmed) > 0 THEN 6 WHEN listed IS NOT NULL THEN 7
             WHEN len(possible) > 0 THEN 8 WHEN regexp_matches(trim(title), '(…|\.\.\.)\s*$') THEN 9 WHEN generic <> '' AND len(others) = 0 THEN 10 WHEN len(kept) > 0 THEN 11 ELSE 12 END AS way FROM h)
    SELECT doc_id, CASE WHEN way IN (1, 5, 12) THEN 'trash' WHEN way IN (2, 4, 6) THEN 'member' WHEN way = 11 THEN 'hidden' ELSE 'hold' END AS bucket,
           CASE way WHEN 1 THEN 'title says that it is over' WHEN 2 THEN 'job is known' WHEN 3 THEN 'attachment not read: ' || lang WHEN 4 THEN 'attachment names the profession'
             WHEN 5 THEN CASE WHEN len(theirs) > 0 THEN 'title: ' || CASE WHEN len(named) > 0 THEN array_to_string(named, '·') ELSE '-' END || ' -> attachment: ' || array_to_string(theirs, '·') ELSE 'attachment read, no profession' END
             WHEN 6 THEN 'title names the profession' WHEN 7 THEN 'several in brackets' WHEN 8 THEN 'word that may be ours' WHEN 9 THEN 'title is cut off' WHEN 10 THEN 'title without a profession'
             WHEN 11 THEN 'kept without being shown' ELSE 'no word of ours' || CASE WHEN len(others) > 0 THEN ' (title: ' || others[1] || ')' ELSE '' END END AS reason,
           array_to_string(CASE way WHEN 1 THEN [ended] WHEN 4 THEN ours WHEN 5 THEN theirs WHEN 6 THEN confirmed WHEN 7 THEN [trim(listed)] WHEN 8 THEN possible WHEN 10 THEN [generic] WHEN 11 THEN kept
             WHEN 12 THEN CASE WHEN len(others) > 0 THEN [others[1]] ELSE [] END ELSE [] END, ',') AS hits,
           CASE WHEN way = 5 THEN array_to_string(named, '·') WHEN way IN (6, 7, 8, 9, 10, 11, 12) AND len(alike) > 0 THEN 'without ' || array_to_string(alike, '·') ELSE '' END AS memo, way IN (3, 9, 10) AS retry
    FROM w JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)
    """
)
def posting_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as postings: their first lines as titles, some with a known job, some with their whole
    text as an attachment, read or not, through the whole ladder."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    title = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    part = F.col("doc_id") % 4
    read = F.when(part == 1, False).when(part > 1, True)
    job = F.when(F.col("doc_id") % 11 == 0, F.lit("known"))
    found = triage.triaged(docs, title, job, read, F.col("text"), F.col("lang"), OF_DOCUMENTS)
    t = F.col("triage")
    return found.select("doc_id", t["bucket"].alias("bucket"), t["reason"].alias("reason"), F.array_join(t["hits"], ",").alias("hits"), t["memo"].alias("memo"), t["retry"].alias("retry"))


STEPS = (
    ("물리치료사(정규직)", "물리치료사", False),
    ("물리치료사, 작업치료사", "공통", True),
    ("간호사 또는 물리치료사", None, True),
    ("작업 치료사", "작업치료사", False),
    ("일반직 5급", None, True),
    ("사회복지직(물리치료사)", "물리치료사", False),
    (None, None, False),
)
POSITIONS = (("소아 물리치료", "소아"), ("성인", "성인"), ("장애 전형", "장애"), ("일반", "일반"), ("대구 근무", None), ("부산 근무", "부산"), ("기타", None), (None, None))
FILES = (("채용 공고문.hwp", 2), ("응시원서 및 서식.hwp", 0), ("직무.pdf", 1), ("4.블라인드 관련 유의사항.pdf", -1), ("wa_site.pdf", -1), (None, 1))


@query(
    f"""
    SELECT p_partkey, {chosen_sql([s[1] for s in STEPS], 'p_partkey')} AS job, CAST({chosen_sql([int(s[2]) for s in STEPS], 'p_partkey')} AS INTEGER) = 1 AS mixed,
           {chosen_sql([p[1] for p in POSITIONS], 'p_partkey')} AS splitter, CAST({chosen_sql([f[1] for f in FILES], 'p_partkey')} AS INTEGER) AS score
    FROM part
    """
)
def steps_and_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Professions of steps with vetoes, what parts a group, and how useful attachments are."""
    k = F.col("p_partkey")
    group = triage.job_group(chosen([s[0] for s in STEPS], k))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        group["job"].alias("job"),
        group["mixed"].alias("mixed"),
        triage.splitter(chosen([p[0] for p in POSITIONS], k), F.lit("대구병원"), ("광주", "대구", "부산", "서울")).alias("splitter"),
        triage.attachment_score(chosen([f[0] for f in FILES], k)).alias("score"),
    )


GROUPS = ("물리치료_인천", "대전병원 물리치료", "물리치료_제주", "물리치료 - 창원", "물리치료")
KNOWN = ("인천병원", "대전병원", "창원요양원")


@query(
    """
    WITH n AS (SELECT s_nationkey, list(DISTINCT CASE s_suppkey % 3 WHEN 0 THEN '인천병원' WHEN 1 THEN '대전병원' ELSE '창원요양원' END) AS known FROM supplier GROUP BY s_nationkey),
    p AS (SELECT s.*, known, s_suppkey % 5 AS g, s_suppkey % 4 = 3 AS titled FROM supplier s JOIN n USING (s_nationkey))
    SELECT s_suppkey, CASE WHEN g = 1 THEN '대전병원' WHEN titled THEN '서울의원' WHEN g = 0 AND list_contains(known, '인천병원') THEN '인천병원' WHEN g = 3 AND list_contains(known, '창원요양원') THEN '창원요양원' END AS workplace,
           CASE WHEN g = 1 OR titled THEN 'named' WHEN g = 0 AND list_contains(known, '인천병원') OR g = 3 AND list_contains(known, '창원요양원') THEN 'region with a known workplace' END AS source
    FROM p
    """
)
def workplaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workplaces named, or told by a region and what the organisation's own data have."""
    k = F.col("s_suppkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", chosen(("인천병원", "대전병원", "창원요양원"), k).alias("own"))
    known = supplier.groupBy("s_nationkey").agg(F.collect_set("own").alias("known"))
    found = triage.workplace(chosen(GROUPS, k), F.when(k % 4 == 3, "[서울의원] 채용"), F.col("known"))
    return supplier.join(known, "s_nationkey").select("s_suppkey", found.alias("w")).select("s_suppkey", "w.*")


CODED = (
    ("306500", False, "직원 채용", "keep", "code"),
    ("307903", False, "물리(작업)치료사 모집", "hold", "wrong code"),
    ("550100", False, "요양보호사 모집", "drop", "other profession"),
    ("1", True, "작업치료사 모집", "keep", "keyword, title"),
    ("1", True, "재활센터 인력", "hold", "keyword, may be"),
    ("1", True, "물리치료실 완비 요양보호사 모집", "hold", "keyword, may be"),
    (None, False, "간호사, 물리치료사", "drop", "other profession"),
    (None, None, None, "drop", "other profession"),
)


@query(
    f"""
    WITH p AS (SELECT event_id, {chosen_sql([c[3] for c in CODED], 'event_id')} AS verdict, {chosen_sql([c[4] for c in CODED], 'event_id')} AS why FROM events)
    SELECT verdict, why, count(*) AS n FROM p GROUP BY verdict, why
    """
)
def code_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of what codes keep and of each exception that titles make."""
    code, extra, title = (chosen([c[i] for c in CODED], F.col("event_id")) for i in range(3))
    found = triage.by_code(code, ("306500", "306501", "306502"), extra.cast("boolean"), title)
    return table(spark, sf_dir, "events").select(found.alias("f")).groupBy("f.verdict", "f.why").agg(F.count("*").alias("n"))


@query(
    """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'title' WHEN 1 THEN 'duty' END AS decided_by, event_id % 4 = 2 AS only_preferred,
           CASE WHEN event_id % 4 < 2 THEN CASE WHEN event_id % 3 = 0 THEN 'hold' ELSE 'member' END WHEN event_id % 4 = 2 THEN 'hold' ELSE 'trash' END AS bucket
    FROM events
    """
)
def preference_never_decides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that name the profession; preferences only hold a row, and so do texts read from pictures."""
    k = F.col("event_id")
    word = lambda i: F.when(k % 4 == i, "물리 치료사").otherwise("기타")
    row = F.create_map(F.lit("title"), word(0), F.lit("duty"), word(1), F.lit("preferred"), word(2), F.lit("memo"), F.lit(None).cast("string"))
    found = triage.by_columns(row, ("preferred",))
    of_picture = k % 3 == 0
    rows = table(spark, sf_dir, "events").select("event_id", found.alias("f"), of_picture.alias("of_picture"))
    bucket = F.when(F.col("f.column").isNotNull(), F.when(F.col("of_picture"), "hold").otherwise("member")).when(F.col("f.only_preferred"), "hold").otherwise("trash")
    return rows.select("event_id", F.col("f.column").alias("decided_by"), F.col("f.only_preferred").alias("only_preferred"), bucket.alias("bucket"))


LINKS = (("https://a.kr/1", None, "http://h.kr"), (None, "http://b.kr", "http://h.kr"), ("ftp://x", " ", "http://h.kr"), (None, None, "no"), (" https://a.kr/2 ", "http://b.kr", None))
CONTRACTS = (("6", None, None, "계약직"), ("무기계약 전환 검토", None, None, None), (None, "근로계약 12개월", None, None), (None, "기간의 정함이 없는 근로계약", None, "정규직"),
             (None, None, "계약기간 : 임용일 ~ 2년", "계약직"), (None, None, "근무기간 3년 이상", "정규직"), ("500", None, None, None), (None, None, None, "계약직"))
LENGTHS = ("6개월", "무기계약 전환 검토", "12개월", "기간의 정함 없음", "24개월", "기간의 정함 없음", None, None)


@query(
    f"""
    SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'http://hosp.kr' ELSE {chosen_sql(("https://a.kr/1", "http://b.kr", "http://h.kr", None, "https://a.kr/2"), 'o_orderkey')} END AS url,
           CASE WHEN o_orderkey % 7 = 0 THEN 'hospital' ELSE {chosen_sql(("posting", "board", "home", "none", "posting"), 'o_orderkey')} END AS kind,
           {chosen_sql(LENGTHS, 'o_orderkey')} AS contract,
           CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 100 WHEN o_orderkey % 2 = 0 THEN 50 END AS pay,
           CASE WHEN o_orderkey % 3 > 0 THEN coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 5 = 1 END, false) WHEN o_orderkey % 2 = 0 THEN true END AS estimated,
           CASE WHEN o_orderkey % 3 > 0 THEN 'stated' WHEN o_orderkey % 2 = 0 THEN 'estimated' ELSE 'unknown' END AS source
    FROM orders
    """
)
def links_and_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where to apply, how long a contract is, and which pay counts."""
    k = F.col("o_orderkey")
    posting, board, home = (chosen([x[i] for x in LINKS], k) for i in range(3))
    link = triage.apply_link(posting, board, home, F.when(k % 7 == 0, "http://hosp.kr"))
    length = triage.contract_length(*[chosen([c[i] for c in CONTRACTS], k) for i in range(4)])
    pay = triage.resolved_pay(F.when(k % 3 > 0, k % 100), F.when(k % 2 == 0, F.lit(50).cast("long")), F.when(k % 5 > 0, k % 5 == 1))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", link.alias("l"), length.alias("contract"), pay.alias("p"))
    return rows.select("o_orderkey", "l.url", "l.kind", "contract", "p.pay", "p.estimated", "p.source")


PROCESSES = (
    ("서류전형(1차) 면접(2차)", 3, "서류|면접|최종", "text"),
    ("1차 서류전형, 2차: 면접", 2, "서류|면접", "text"),
    ("서류(1차) 면접(3차)", 2, "서류|면접", "text"),
    ("서류 후 필기, 면접", 3, "서류|필기|면접", "text"),
    ("서류", 4, "서류|면접|3차|최종", "default"),
    (None, 1, "최종", "text"),
    ("", 3, "서류|면접|최종", "default"),
    ("면접 구술", 5, "서류|면접|3차|4차|최종", "default"),
)


@query(
    f"""
    SELECT p_partkey, {chosen_sql([p[2] for p in PROCESSES], 'p_partkey')} AS names, {chosen_sql([p[3] for p in PROCESSES], 'p_partkey')} AS source FROM part
    """
)
def named_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of recruitment steps: numbered, in reading order, or by default."""
    k = F.col("p_partkey")
    found = triage.step_names(chosen([p[0] for p in PROCESSES], k), chosen([p[1] for p in PROCESSES], k))
    rows = table(spark, sf_dir, "part").select("p_partkey", found.alias("found"))
    return rows.select("p_partkey", F.array_join("found.names", "|").alias("names"), "found.source")


@query(
    """
    WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN CASE WHEN value < 250 THEN 'gone' ELSE 'unknown' END WHEN event_type = 'purchase' THEN 'closed' ELSE 'alive' END AS state FROM events),
    n AS (SELECT *, count(*) FILTER (state <> 'gone' AND state <> 'unknown') OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e)
    SELECT user_id, count(*) FILTER (state = 'gone') AS n_gone, count(*) FILTER (state = 'closed') AS n_closed,
           coalesce(max(strikes), 0) >= 2 OR count(*) FILTER (state = 'closed') > 0 AS hide
    FROM (SELECT *, count(*) FILTER (state = 'gone') OVER (PARTITION BY user_id, run) AS strikes FROM n) GROUP BY user_id
    """
)
def liveness_strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings hidden once closed, or after two strikes: gone twice without having been alive between
    (what is unknown neither counts nor clears)."""
    state = F.when(F.col("event_type") == "error", F.when(F.col("value") < 250, "gone").otherwise("unknown")).when(F.col("event_type") == "purchase", "closed").otherwise("alive")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", state.alias("state"))
    checks = rows.groupBy("user_id").agg(
        F.count_if(F.col("state") == "gone").alias("n_gone"), F.count_if(F.col("state") == "closed").alias("n_closed")
    )
    run = F.count_if(~F.col("state").isin("gone", "unknown")).over(Window.partitionBy("user_id").orderBy("event_id"))
    strikes = rows.withColumn("run", run).filter("state = 'gone'").groupBy("user_id", "run").count().groupBy("user_id").agg(F.max("count").alias("strikes"))
    hide = (F.coalesce("strikes", F.lit(0)) >= 2) | (F.col("n_closed") > 0)
    return checks.join(strikes, "user_id", "left").select("user_id", "n_gone", "n_closed", hide.alias("hide"))


CONDITIONS = (
    ("필수: 면허, 경력 2년 우대, 차량 / 우대: 영어, 일어 ; required: shift", "면허|차량|shift", "경력 2년|영어|일어"),
    ("물리치료사 면허증(기타: 도수치료, 필라테스 우대), 운전", "물리치료사 면허증(기타: 도수치료, 필라테스 우대)|운전", ""),
    ("우대 없음, 면허 소지자", "면허 소지자", ""),
    ("[우대사항] 소아 경력, [필수] 면허", "면허", "소아 경력"),
    ("면허 필수 경력 우대", "면허 필수 경력 우대", ""),
    (None, None, None),
)
LICENCES = (("both", "물리치료사 면허", "물리치료사"), ("both", "물리치료사 우대", "both"), ("both", "물리치료사, 작업치료사", "both"), ("one", "작업치료사", "one"), ("both", "", "both"))


@query(
    f"""
    SELECT p_partkey, {chosen_sql([c[1] for c in CONDITIONS], 'p_partkey')} AS must, {chosen_sql([c[2] for c in CONDITIONS], 'p_partkey')} AS may,
           {chosen_sql([x[2] for x in LICENCES], 'p_partkey')} AS licence, p_partkey % 3 <> 1 AS complete
    FROM part
    """
)
def conditions_and_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Required and preferred conditions, licences narrowed to the one that is named, complete rows."""
    k = F.col("p_partkey")
    must, may = labels.required_and_preferred(chosen([c[0] for c in CONDITIONS], k))
    licence = labels.single_licence(chosen([x[0] for x in LICENCES], k), ("물리치료사", "작업치료사"), chosen([x[1] for x in LICENCES], k))
    fields = [F.when(k % 3 > 0, k), F.when(k % 3 == 2, k)]
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(must, "|").alias("must"), F.array_join(may, "|").alias("may"), licence.alias("licence"), labels.complete_or_empty(fields).alias("complete")
    )


SPELT = (
    ("물리(작업)치료사 모집", "물리치료사 작업치료사 모집"),
    ("작업·물리 치료사", "작업치료사 물리치료사"),
    ("물 리 치료사, 작 업 치 료 사", "물리치료사, 작업치료 사"),
    ("치료사(물리, 작업)", "물리치료사 작업치료사"),
    ("기간제(물리작업치료사)", "기간제(치료사)"),
    ("물리 및 작업치료직", "물리치료직 작업치료직"),
    (None, ""),
)
#: By hand, name, declared, title, attachment; the type and its evidence.
EMPLOYED = (
    ("정규직", "기간제 물리치료사", ("계약직",), None, None, "정규직", "by hand"),
    (None, "물리치료사(기간제)", ("계약직",), None, None, "기간제", "name"),
    (None, "물리치료사", ("계약직", "계약직"), None, None, "계약직", "declared"),
    (" ", "물리치료사", ("무기계약직", "기간제"), "공무직(방사선사) 및 기간제근로자(물리치료사) 채용", None, "기간제", "title"),
    (None, "물리치료사", ("정규직", "기간제"), "공무직(방사선사) 및 기간제근로자(물리치료사) 채용", "기간제근로자", "기간제", "attachment"),
    (None, None, (), None, "정규직 또는 계약직", None, None),
)
PLACED = (("경기광주병원", "서울", "경기광주"), ("물리치료", " 대구 ", "대구"), ("물리치료", "대구, 부산", None), (None, None, None), ("경 기 물리", None, "경기"))


@query(
    f"""
    SELECT p_partkey, {chosen_sql([s[1] for s in SPELT], 'p_partkey')} AS spelt, {chosen_sql([e[5] for e in EMPLOYED], 'p_partkey')} AS employment,
           {chosen_sql([e[6] for e in EMPLOYED], 'p_partkey')} AS source, {chosen_sql([p[2] for p in PLACED], 'p_partkey')} AS region
    FROM part
    """
)
def spelt_and_employed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Professions spelt out, types of employment by five kinds of evidence, regions by name or place."""
    k = F.col("p_partkey")
    hand, name, _, title, attachment = (chosen([e[i] if i != 2 else None for e in EMPLOYED], k).cast("string") for i in range(5))
    declared = F.split(chosen([",".join(e[2]) for e in EMPLOYED], k), ",")
    declared = F.filter(declared, lambda x: x != "")
    found = triage.employment_type(hand, name, declared, title, attachment)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        triage.spelt_out(chosen([s[0] for s in SPELT], k)).alias("spelt"),
        found["employment"].alias("employment"),
        found["source"].alias("source"),
        triage.region_of(chosen([p[0] for p in PLACED], k), chosen([p[1] for p in PLACED], k), ("경기", "광주", "경기광주", "서울")).alias("region"),
    )
