"""The automaton against plain search, and the triage's ladder on titles whose verdicts are known."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import triage
from millrace.functions.dictionary import BLANKS, Dictionary, occurrences

#: Titles with the bucket, the reason and the words that decide where neither job nor attachment is known.
TITLES = (
    ("물리치료사 채용 공고", "member", "title names the profession", "물리치료"),
    ("물리 치료사, 언어치료사 모집", "member", "title names the profession", "물리치료"),
    ("언어치료사 모집", "trash", "no word of ours", ""),
    ("병원 직원 채용 (간호사, 조리사, 행정)", "hold", "several in brackets", "간호사, 조리사, 행정"),
    ("의료기사 채용", "hold", "word that may be ours", "의료기사"),
    ("요양원 상담 인력 모집", "hold", "word that may be ours", "요양원,상담"),
    ("전남권 어린이병원(목포중앙병원) ...", "hold", "title is cut off", ""),
    ("2026년 하반기 신규 직원 채용", "hold", "title without a profession", "신규 직원"),
    ("방사선사 채용", "hidden", "kept without being shown", "방사선사"),
    ("원무과 직원 채용 간호사", "trash", "no word of ours (title: 간호사)", "간호사"),
    ("시설 청소원 모집", "trash", "no word of ours", ""),
    ("물리치료사 채용 공고 [마감]", "trash", "title says that it is over", "[마감"),
    ("통합채용 필기시험 장소 변경 공고", "trash", "title says that it is over", "필기시험"),
    ("방사선치료사 채용", "trash", "no word of ours", ""),
    (None, "trash", "no word of ours", ""),
)
#: Whether an attachment was read, its text, why not; the bucket, the reason and the words that decide.
ATTACHED = (
    (False, None, "429", "hold", "attachment not read: 429", ""),
    (False, "물리치료사", None, "hold", "attachment not read: unknown", ""),
    (True, "채용 분야 작업 치료사 1명", None, "member", "attachment names the profession", "작업치료"),
    (True, "간호사 2명, 방사선사 1명", None, "trash", "title: 의료기사 -> attachment: 간호사·방사선사", "간호사,방사선사"),
    (True, "간 호 사 2명", None, "trash", "attachment read, no profession", ""),
    (True, None, None, "trash", "attachment read, no profession", ""),
)


def test_all_words_with_their_places():
    rng = random.Random(4)
    words = ("ab", "b", "abc", "c", "ba b", "ab", "가나", "😀a")
    for _ in range(400):
        text = "".join(rng.choice("abc 가나😀\n　") for _ in range(rng.randrange(25)))
        want = []
        for i, w in enumerate(words):
            w = "".join(c for c in w if c not in BLANKS)
            for begin in range(len(text)):
                if text[begin] in BLANKS:
                    continue
                rest = [k for k in range(begin, len(text)) if text[k] not in BLANKS][: len(w)]
                if "".join(text[k] for k in rest) == w:
                    want.append((i, begin, rest[-1] - begin + 1 != len(w)))
        assert occurrences(text, words) == sorted(want)
    assert occurrences("abc", ()) == []


def test_hits_keep_the_lists_order(spark):
    words = Dictionary((("one", ("b", "a", "x y")), ("two", ("a", "q"))))
    rows = spark.createDataFrame([("a b a", 0), (None, 1), ("", 2), ("x  y a", 3)], "t string, k int")
    found = rows.withColumn("f", words.find(F.col("t")))
    got = found.select("k", words.hits(F.col("f"), "one"), words.hits(F.col("f"), "one", together=True), words.hits(F.col("f"), "two")).collect()
    assert sorted(tuple(r) for r in got) == [(0, ["b", "a"], ["b", "a"], ["a"]), (1, None, None, None), (2, [], [], []), (3, ["a", "x y"], ["a"], ["a"])]
    with pytest.raises(KeyError):
        words.hits(F.col("f"), "three")


def test_the_ladder(spark):
    rows = [(t, None, None, None, None, b, r, h) for t, b, r, h in TITLES]
    rows += [("의료기사 채용", None, a, t, w, b, r, h) for a, t, w, b, r, h in ATTACHED]
    rows += [("언어치료사", "물리치료사", True, "청소", None, "member", "job is known", ""), ("채용 완료", "물리치료사", None, None, None, "trash", "title says that it is over", "채용 완료")]
    df = spark.createDataFrame(rows, "title string, job string, read boolean, body string, reason string, triage string, want string, words string")
    out = triage.triaged(df, F.col("title"), F.col("job"), F.col("read"), F.col("body"), F.col("reason"))
    assert out.columns == ["title", "job", "read", "body", "reason", "want", "words", "triage"]
    got = {(r["title"], r["job"], r["read"], r["body"], r["reason"]): r["triage"] for r in out.collect()}
    for title, job, read, body, why, bucket, reason, words in rows:
        t = got[title, job, read, body, why]
        assert (t["bucket"], t["reason"], ",".join(t["hits"])) == (bucket, reason, words), title
    assert got["언어치료사 모집", None, None, None, None]["memo"] == "without 언어치료사"


def test_rules_are_not_repeated_in_the_plan(spark):
    from millrace.plans import catalog

    plan = catalog.QUERIES["posting_triage"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("no word of ours") == 1 and "contains(" not in plan.lower()


def test_step_names_are_worked_out_once(spark):
    from millrace.plans import catalog

    plan = catalog.QUERIES["named_steps"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.upper().count("RLIKE") <= 5 * len(triage.STEP_WORDS) + 5 + 1 + len(triage.STEP_WORDS)
    texts = (("1차 서류, 3차 면접", 2, "서류|면접", "text"), ("서류(1차) 실기(3차)", 3, "서류|실기|최종", "text"), ("7차 면접", 1, "면접", "text"), ("면접", None, "서류|면접|3차|최종", "default"))
    rows = spark.createDataFrame(texts, "t string, n int, names string, source string")
    f = triage.step_names(F.col("t"), F.col("n"))
    got = rows.select("names", "source", F.array_join(f["names"], "|"), f["source"]).collect()
    assert [r[2:] for r in got] == [r[:2] for r in got]
