"""Which postings are for members: ordered rules over titles, jobs and attachments.

Every rule looks at a title without white space, unless it says otherwise. The order is the
specification. The words of all lists are found by one automaton; the rules are column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.dictionary import Dictionary
from millrace.functions.text import bound, listed_in_brackets, squeeze

# The word lists of the domain.
#: Words that say that a posting is for the members' professions.
CONFIRMED = ("작업치료", "물리치료")
#: Words that only look as if they did; they are cut out before the title is judged.
LOOK_ALIKES = ("언어치료사", "심리치료사", "미술치료사", "음악치료사", "놀이치료사", "방사선치료사")
#: Words with which a posting may be for members, so that it is never thrown away unread.
POSSIBLE = (
    "보건직", "의료기사", "의료기술직", "재활치료실", "작업치료사", "물리치료사", "아동", "감통", "감각통합", "도수치료",
    "소아치료실", "직업재활", "통증치료실", "열전기치료실", "방문재활", "요양원", "재활센터", "헬스", "트레이너", "필라테스",
    "요가", "정신건강", "정신", "상담", "치료사", "특수체육", "재활치료", "작업치료", "물리치료",
)
#: Other professions, as an attachment or a title names them.
OTHERS = (
    "간호사", "간호조무사", "의사", "약사", "방사선사", "임상병리사", "치과위생사", "응급구조사", "영양사", "조리사",
    "사회복지사", "요양보호사", "언어재활사", "운동처방사", "보건관리자", "안전관리자",
)
#: Professions that are kept without being shown.
KEPT_HIDDEN = ("임상병리사", "방사선사")
#: A title that says that a posting is over, or that only announces results, places or dates.
ENDED = r"\[\s*마감|마감\s*\]|채용\s*(?:완료|마감)|모집\s*(?:완료|마감)|합격자|결과\s*(?:발표|공고|안내)|시험\s*장소|장소\s*(?:변경|공고|안내)|응시\s*장소|고사\s*장|면접\s*장소|필기\s*시험(?!\s*(?:과목|방법))|일정\s*(?:변경|안내)\s*공고"
#: A title that is cut off, and one that names no profession.
CUT_OFF = r"(?:…|\.\.\.)\s*$"
GENERIC = r"직원\s*(?:채용|모집)|일반직|공무직|기간제|계약직|신규\s*(?:채용|직원)|정기\s*채용|통합\s*채용"
#: Other licences that veto a group of postings by its name, and marks of groups that are several in one.
OTHER_LICENCES = "치과기공사|치과위생사|임상병리사|방사선사|간호조무사|간호사|사회복지사|영양사|약사|언어재활사|응급구조사|보건의료정보관리사|조리사|운동처방사|안경사|의무기록사|위생사"
SEVERAL = "[,，·ㆍ/]|또는|및"
VAGUE = "일반직|공무직|기간제|계약직|업무지원|통합|전체|직원"


def hits(text: Column, words: Sequence[str]) -> Column:
    """The words of a list that a text contains, in the list's order."""
    return F.array_compact(F.array(*[F.when(text.contains(w), F.lit(w)) for w in words]))


def without(text: Column, words: Sequence[str]) -> Column:
    for w in words:
        text = F.replace(text, F.lit(w), F.lit(""))
    return text


VERDICT = "struct<bucket:string,stage:int,reason:string,hits:array<string>,memo:string,retry:boolean>"


@dataclass(frozen=True)
class Lists:
    """What a triage goes by: the words of each list and the patterns of titles."""

    confirmed: tuple[str, ...] = CONFIRMED
    look_alikes: tuple[str, ...] = LOOK_ALIKES
    possible: tuple[str, ...] = POSSIBLE
    others: tuple[str, ...] = OTHERS
    kept_hidden: tuple[str, ...] = KEPT_HIDDEN
    ended: str = ENDED
    generic: str = GENERIC

    def dictionary(self) -> Dictionary:
        names = ("confirmed", "look_alikes", "possible", "others", "kept_hidden")
        return Dictionary(tuple((n, getattr(self, n)) for n in names))


def _verdict(bucket: str, stage: int, reason: Column, found: Column | None = None, memo: Column | None = None, retry: bool = False) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        F.lit(bucket).alias("bucket"),
        F.lit(stage).alias("stage"),
        reason.alias("reason"),
        (none if found is None else found).alias("hits"),
        (F.lit("") if memo is None else memo).alias("memo"),
        F.lit(retry).alias("retry"),
    ).cast(VERDICT)


def _listed(words: Column) -> Column:
    return F.array_join(words, "·")


def _of_attachment() -> Column:
    """What an attachment decides. Unread, the posting is held and read again; with the members'
    professions it is theirs; else it goes, with the professions that it names (six at most)."""
    some, theirs = F.size("possible_title") > 0, F.slice("body_others", 1, 6)
    named = F.concat(F.lit("title: "), F.when(some, _listed(F.col("possible_title"))).otherwise("-"), F.lit(" -> attachment: "), _listed(theirs))
    reason = F.when(F.size(theirs) > 0, named).otherwise("attachment read, no profession")
    unread = F.concat(F.lit("attachment not read: "), F.coalesce("why", F.lit("unknown")))
    return (
        F.when(~F.col("read"), _verdict("hold", 5, unread, retry=True))
        .when(F.size("body_ours") > 0, _verdict("member", 5, F.lit("attachment names the profession"), F.col("body_ours")))
        .otherwise(_verdict("trash", 5, reason, theirs, F.when(some, _listed(F.col("possible_title"))).otherwise("")))
    )


def _ladder() -> Column:
    """The rules in their order over the columns that ``triaged`` has worked out."""
    memo = F.when(F.size("alike") > 0, F.concat(F.lit("without "), _listed(F.col("alike")))).otherwise("")
    nothing = F.concat(F.lit("no word of ours"), F.when(F.size("others") > 0, F.concat(F.lit(" (title: "), F.get("others", F.lit(0)), F.lit(")"))).otherwise(""))
    some = lambda name: F.size(name) > 0
    return (
        F.when(F.col("ended") != "", _verdict("trash", 4, F.lit("title says that it is over"), F.array("ended")))
        .when(F.col("known_job"), _verdict("member", 1, F.lit("job is known")))
        .when(F.col("read").isNotNull(), _of_attachment())
        .when(some("confirmed"), _verdict("member", 1, F.lit("title names the profession"), F.col("confirmed"), memo))
        .when(F.col("in_brackets").isNotNull(), _verdict("hold", 2, F.lit("several in brackets"), F.array(F.trim("in_brackets")), memo))
        .when(some("possible"), _verdict("hold", 2, F.lit("word that may be ours"), F.col("possible"), memo))
        .when(F.col("cut_off"), _verdict("hold", 2, F.lit("title is cut off"), None, memo, True))
        .when((F.col("generic") != "") & ~some("others"), _verdict("hold", 2, F.lit("title without a profession"), F.array("generic"), memo, True))
        .when(some("kept_hidden"), _verdict("hidden", 4, F.lit("kept without being shown"), F.col("kept_hidden"), memo))
        .otherwise(_verdict("trash", 4, nothing, F.slice("others", 1, 1), memo))
    )


def triaged(
    df: DataFrame,
    title: Column,
    job: Column,
    read: Column | None = None,
    text: Column | None = None,
    why: Column | None = None,
    lists: Lists = Lists(),
) -> DataFrame:
    """``df`` with ``triage``, a verdict for each posting: bucket, stage, reason, the words that decided, what
    was left aside, and whether it is to be read again.

    ``job``: the job where it is known; ``read``: null without an attachment, else whether it was read,
    with its ``text`` or ``why`` not. Each title and text goes through one automaton of all lists once; a title
    that has look-alikes goes through it again without them. All rules are evaluated once for a row.
    A null title has no words; an input column named triage is replaced."""
    words = lists.dictionary()
    none = F.lit(None).cast("string")
    read = F.lit(None).cast("boolean") if read is None else read
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns if c.lower() != "triage"]).alias("row"),
        F.coalesce(title, F.lit("")).alias("title"),
        (F.trim(F.coalesce(job, F.lit(""))) != "").alias("known_job"),
        read.alias("read"),
        F.when(read, F.coalesce(none if text is None else text, F.lit(""))).alias("text"),
        (none if why is None else why).alias("why"),
    )
    rows = rows.withColumns({"in_title": words.find(F.col("title")), "in_text": words.find(F.col("text"))}).drop("text")
    rows = rows.withColumn("alike", words.hits(F.col("in_title"), "look_alikes"))
    bare = F.when(F.size("alike") > 0, without(squeeze(F.col("title")), lists.look_alikes))
    rows = rows.withColumn("in_bare", words.find(bare))
    rows = rows.withColumn("in_bare", F.coalesce("in_bare", "in_title"))
    rows = rows.select(
        "row", "read", "why", "known_job", "alike",
        *[words.hits(F.col("in_bare"), n).alias(n) for n in ("confirmed", "possible", "kept_hidden")],
        words.hits(F.col("in_title"), "others").alias("others"),
        words.hits(F.col("in_title"), "possible").alias("possible_title"),
        words.hits(F.col("in_text"), "confirmed").alias("body_ours"),
        words.hits(F.col("in_text"), "others", together=True).alias("body_others"),
        F.regexp_extract("title", f"({lists.ended})", 1).alias("ended"),
        F.regexp_extract("title", f"({lists.generic})", 1).alias("generic"),
        F.trim("title").rlike(CUT_OFF).alias("cut_off"),
        listed_in_brackets(F.col("title")).alias("in_brackets"),
    )
    # bound once, so that taking its fields doesn't repeat the ladder
    verdict = F.get(F.transform(F.array(_ladder()), lambda v: v), F.lit(0))
    return rows.select("row.*", verdict.alias("triage"))


def job_group(step_name: Column) -> Column:
    """The profession of a recruitment step by its name (both, one or null; another licence vetoes),
    and whether it is several in one."""
    name = F.coalesce(step_name, F.lit(""))
    bare = squeeze(name)
    physical, occupational = bare.contains("물리치료"), bare.contains("작업치료")
    own = F.when(physical & occupational, "공통").when(physical, "물리치료사").when(occupational, "작업치료사")
    other = F.regexp_replace(bare, "물리치료사|작업치료사|물리치료|작업치료", "").rlike(OTHER_LICENCES)
    own = F.when(~other, own)
    mixed = name.rlike(SEVERAL) | own.isNull() & (name != "")
    return F.struct(own.alias("job"), mixed.alias("mixed"))


def splitter(position: Column, workplace: Column, places: Sequence[str]) -> Column:
    """What parts postings of one group that are not the same: whom they treat, the track, or a place
    that is not the workplace's own; null for nothing."""
    s, at = F.coalesce(position, F.lit("")), F.coalesce(workplace, F.lit(""))
    out = F.when(s.rlike("소아|어린이"), "소아").when(s.contains("성인"), "성인").when(s.contains("장애"), "장애").when(s.contains("일반"), "일반")
    place = F.get(hits(s, places), F.lit(0))
    return out.when(place.isNotNull() & ~F.contains(at, place), place)


#: Endings of workplaces that a region in a name may stand for (fixed values).
WORKPLACE_ENDS = ("병원", "의원", "요양원", "분원")
WORKPLACE = r"([가-힣]{2,10}(?:병원|의원|요양원|분원|센터))"


def workplace(group: Column, title: Column, known: Column) -> Column:
    """The workplace that a group's name or, in square brackets or plainly, its title names; else the
    region at the name's end with an ending, if the organisation's data (``known``, an array) has
    such a workplace. With where it comes from."""
    found = lambda s, p: F.nullif(F.regexp_extract(F.coalesce(s, F.lit("")), p, 1), F.lit(""))
    direct = F.coalesce(found(group, WORKPLACE), found(title, rf"\[{WORKPLACE}\]"), found(title, WORKPLACE))
    tail = found(group, r"[_·-]\s*([가-힣]{2,4})\s*$")
    guesses = [F.when(F.array_contains(known, F.concat(tail, F.lit(e))), F.concat(tail, F.lit(e))) for e in WORKPLACE_ENDS]
    guess = F.coalesce(*guesses)
    return F.struct(
        F.coalesce(direct, guess).alias("workplace"),
        F.when(direct.isNotNull(), "named").when(guess.isNotNull(), "region with a known workplace").alias("source"),
    )


def by_code(code: Column, ours: Sequence[str], extra: Column, title: Column) -> Column:
    """Keep, hold or drop by a job's code, with the exceptions that titles make: a code of ours keeps; of
    another code, a title with our profession (brackets spelt out) and no other one is held; what
    came by a keyword is kept where its title confirms it and held where it may be ours."""
    t = F.coalesce(title, F.lit(""))
    spelt = F.regexp_replace(squeeze(t), r"물리\(작업\)치료|작업\(물리\)치료|물리[,/·]작업치료|작업[,/·]물리치료", "물리치료작업치료")
    named = F.size(hits(without(spelt, LOOK_ALIKES), CONFIRMED)) > 0
    other = F.size(hits(spelt, OTHERS)) > 0
    maybe = F.size(hits(without(spelt, LOOK_ALIKES), POSSIBLE)) > 0
    keep = F.coalesce(code, F.lit("")).isin(*ours)
    word = F.coalesce(extra, F.lit(False))
    verdict = F.when(keep, "keep").when(word & named & ~other, "keep").when(word & maybe, "hold").when(named & ~other, "hold").otherwise("drop")
    why = F.when(keep, "code").when(word & named & ~other, "keyword, title").when(word & maybe, "keyword, may be").when(named & ~other, "wrong code").otherwise("other profession")
    return F.struct(verdict.alias("verdict"), why.alias("why"))


def by_columns(row: Column, preferences: Sequence[str]) -> Column:
    """The first column of a map whose text names our profession, columns of mere preferences left
    out, and whether only those name it: preference never decides."""
    names = lambda v: F.size(hits(squeeze(F.coalesce(v, F.lit(""))), CONFIRMED)) > 0
    preferred = lambda k: k.isin(*preferences)
    entries = F.map_entries(row)
    deciding = F.get(F.filter(entries, lambda e: ~preferred(e["key"]) & names(e["value"])), F.lit(0))
    only = deciding.isNull() & F.exists(entries, lambda e: preferred(e["key"]) & names(e["value"]))
    return F.struct(deciding["key"].alias("column"), only.alias("only_preferred"))


#: Words of forms and of notices in the names of attachments, and files that are neither (fixed values).
FORMS = "지원서|응시원서|서식|양식|이력서|자기소개|명세서|직무기술|제출서류|동의서"
NOTICE_WORDS = "공고|모집|채용|요강"
NO_NOTICE = "웹\\s*접근성|접근성\\s*마크|블라인드\\s*관련|^safe\\.pdf$|^wa_"


def attachment_score(name: Column) -> Column:
    """How likely an attachment is the notice itself: -1 never, 0 a form, 1 unknown, 2 likely."""
    s = F.coalesce(name, F.lit(""))
    return F.when(s.rlike(NO_NOTICE), -1).when(s.rlike(FORMS), 0).when(s.rlike(NOTICE_WORDS), 2).otherwise(1)


def apply_link(posting: Column, board: Column, home: Column, hospital: Column) -> Column:
    """Where to apply, and what that is: the hospital's own address, the posting's, a board, a home page."""
    good = lambda u: F.when(F.trim(u).rlike("^https?://"), F.trim(u))
    sources = (("hospital", good(hospital)), ("posting", good(posting)), ("board", good(board)), ("home", good(home)))
    kind = F.when(F.lit(False), "")
    for name, value in sources:
        kind = kind.when(value.isNotNull(), name)
    return F.struct(F.coalesce(*[v for _, v in sources]).alias("url"), kind.otherwise("none").alias("kind"))


def contract_length(extracted: Column, declared: Column, text: Column, employment: Column, no_end: str = "기간의 정함 없음") -> Column:
    """How long a contract is: what was extracted, what the declared type says, what a text says behind
    the word for it (years in months, unless a bound), or no end for permanent posts."""
    months = lambda n: F.when((n > 0) & (n <= 120), F.concat(n.cast("string"), F.lit("개월")))
    own = F.trim(F.coalesce(extracted, F.lit("")))
    number = F.regexp_extract(own, r"^([0-9]{1,3})\s*(?:개월)?$", 1)
    of_own = F.when(number != "", months(number.try_cast("int"))).otherwise(F.substring(own, 1, 20))
    stated = F.regexp_extract(F.coalesce(declared, F.lit("")), r"근로계약\s*([0-9]{1,3})\s*개월", 1)
    pattern = r"(?:계약|근무|채용|임용)\s*기간\s*[:：|]?\s*(?:임용일\s*[~∼～-]\s*)?([0-9]{1,3})\s*(년|개월)(?!\s*(?:이상|이내|미만))"
    n, unit = (F.regexp_extract(F.coalesce(text, F.lit("")), pattern, i) for i in (1, 2))
    permanent = F.when(employment == "정규직", no_end)
    return (
        F.when(own != "", of_own)
        .when(stated != "", months(stated.try_cast("int")))
        .when(F.coalesce(declared, F.lit("")).contains("기간의 정함이 없는"), permanent)
        .when(n != "", months(n.try_cast("int") * F.when(unit == "년", 12).otherwise(1)))
        .otherwise(permanent)
    )


def resolved_pay(gross: Column, estimate: Column, is_estimate: Column) -> Column:
    """One pay of a stated and an estimated one: the stated, else the estimate, and whether it is one."""
    return F.struct(
        F.coalesce(gross, estimate).alias("pay"),
        F.when(gross.isNotNull(), F.coalesce(is_estimate, F.lit(False))).when(estimate.isNotNull(), True).alias("estimated"),
        F.when(gross.isNotNull(), "stated").when(estimate.isNotNull(), "estimated").otherwise("unknown").alias("source"),
    )


#: Names of recruitment steps by their number without better knowledge (fixed values).
DEFAULT_STEPS = {1: ("최종",), 2: ("서류", "최종"), 3: ("서류", "면접", "최종")}
STEP_WORDS = (("서류", "서류"), ("필기", "필기"), ("실기", "실기"), ("면접|구술", "면접"), ("신체|체력", "신체"))


def step_names(text: Column, n: Column) -> Column:
    """The names of ``n`` steps: numbered in the text (``서류전형(1차)``; a missing number spoils them),
    else in the order that the text has them, with a last one added where it is one short; else by
    default. With where they come from."""
    return bound(F.struct(F.coalesce(text, F.lit("")).alias("text"), n.alias("n")), lambda x: _named(x["text"], x["n"]))


def _named(t: Column, n: Column) -> Column:
    """``step_names`` of a text that is not null. Each value is worked out once, numbers only where there are any."""
    numbered = []
    for number in range(1, 6):
        name = F.when(F.lit(False), "")
        for pattern, label in STEP_WORDS:
            name = name.when(t.rlike(rf"(?:{pattern})[^()]{{0,14}}\({number}\s*차\)|{number}\s*차\s*[)\]]?\s*[:：–-]?\s*(?:{pattern})"), label)
        numbered.append(F.when(t.rlike(rf"{number}\s*차"), name))

    def by_number(marks: Column) -> Column:
        last = F.array_max(F.transform(marks, lambda x, i: F.when(x.isNotNull(), i + 1)))
        return bound(last, lambda last: bound(F.array_compact(F.slice(marks, F.lit(1), last)), lambda a: F.when(F.size(a) == last, a)))

    words = F.regexp_extract_all(t, F.lit("(" + "|".join(p for p, _ in STEP_WORDS) + ")"), F.lit(1))
    label = lambda w: F.coalesce(*[F.when(w.rlike(f"^(?:{p})$"), F.lit(name)) for p, name in STEP_WORDS])
    in_order = F.array_distinct(F.transform(words, label))
    read = F.coalesce(F.when(t.rlike(r"[1-5]\s*차"), bound(F.array(*numbered), by_number)), in_order)
    many = F.concat(
        F.array(F.lit("서류"), F.lit("면접")),
        F.transform(F.sequence(F.lit(3), F.greatest(n - 1, F.lit(3))), lambda i: F.concat(i.cast("string"), F.lit("차"))),
        F.array(F.lit("최종")),
    )
    default = F.when(n <= 1, F.array(F.lit("최종")))
    for k in (2, 3):
        default = default.when(n == k, F.array(*map(F.lit, DEFAULT_STEPS[k])))
    named = bound(read, lambda r: F.when(F.size(r) == n, r).when(F.size(r) == n - 1, F.concat(r, F.array(F.lit("최종")))))
    return bound(named, lambda x: F.struct(F.coalesce(x, default.otherwise(many)).alias("names"), F.when(x.isNotNull(), "text").otherwise("default").alias("source")))


#: What parts two halves of "physical or occupational therapist" when the noun is written once.
_OR = r"(?:\(\s*|[·ㆍ・/,、&]\s*|(?:및|또는|혹은|와|과)\s+)"


def spelt_out(title: Column) -> Column:
    """A title with the professions' names written in full: blanks within them taken out, halves that
    share one noun (in brackets, with a mark, before or behind it) as two names. Halves written as one
    word are no profession, as nobody can tell which is meant."""
    t = F.coalesce(title, F.lit(""))
    t = F.regexp_replace(t, r"(?:물\s*리\s*작\s*업|작\s*업\s*물\s*리)\s*치\s*료\s*사", "치료사")
    t = F.regexp_replace(F.regexp_replace(t, r"물\s*리\s*치\s*료", "물리치료"), r"작\s*업\s*치\s*료", "작업치료")
    for a, b in (("물리", "작업"), ("작업", "물리")):
        t = F.regexp_replace(t, rf"{a}\s*{_OR}{b}\s*\)?\s*치료\s*(사|직)", f"{a}치료$1 {b}치료$1")
        t = F.regexp_replace(t, rf"치료\s*사\s*\(\s*{a}\s*(?:[,·ㆍ/]|및)\s*{b}\s*\)", f"{a}치료사 {b}치료사")
    return t


#: Types of employment with the words for them, longer words first where one holds another (fixed values).
EMPLOYMENT = (("무기계약", "무기계약직"), ("공무직", "무기계약직"), ("기간제", "기간제"), ("계약직", "계약직"), ("청년인턴", "청년인턴"), ("정규직", "정규직"))


def employment_type(by_hand: Column, name: Column, declared: Column, title: Column, attachment: Column) -> Column:
    """A group's type of employment by five kinds of evidence, and which of them it was: set by hand; in
    the group's name; the only one declared (an array); in the part of the title that names the group's
    profession, if the title's types are just those declared; the only one in an attachment."""
    words = lambda t: F.array_distinct(hits_as(F.coalesce(t, F.lit("")), EMPLOYMENT))
    only = lambda a: F.when(F.size(a) == 1, a[0])
    in_title = words(title)
    agrees = F.array_sort(in_title) == F.array_sort(F.array_distinct(declared))
    parts = F.split(F.coalesce(title, F.lit("")), r"\s*(?:및|,|·|/)\s*(?![^(]*\))")
    own = F.flatten(F.transform(F.filter(parts, lambda p: p.rlike("|".join(CONFIRMED))), words))
    evidence = (
        ("by hand", F.nullif(F.trim(by_hand), F.lit(""))),
        ("name", only(words(name))),
        ("declared", only(F.array_distinct(declared))),
        ("title", F.when(agrees, only(F.array_distinct(own)))),
        ("attachment", only(words(attachment))),
    )
    source = F.when(F.lit(False), "")
    for kind, value in evidence:
        source = source.when(value.isNotNull(), kind)
    return F.struct(F.coalesce(*[v for _, v in evidence]).alias("employment"), source.alias("source"))


def hits_as(text: Column, words: Sequence[tuple[str, str]]) -> Column:
    """The labels of the words that a text contains."""
    return F.array_compact(F.array(*[F.when(text.contains(w), F.lit(label)) for w, label in words]))


def region_of(name: Column, places: Column, regions: Sequence[str]) -> Column:
    """The longest region in a name, else the only place of work (a list with commas, points or slashes),
    else null."""
    found = F.get(hits(squeeze(F.coalesce(name, F.lit(""))), sorted(regions, key=lambda r: (-len(r), r))), F.lit(0))
    listed = F.filter(F.transform(F.split(F.coalesce(places, F.lit("")), "[,·/]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(found, F.when(F.size(listed) == 1, listed[0]))
