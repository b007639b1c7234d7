"""Text expressions: keys for names and urls, markup, redaction, hashes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a browser's script engine has it: ASCII, no-break, ideographic and byte-order mark.
ANY_SPACE = r"[\s 　﻿]+"
#: Legal forms that are no part of an organisation's name (fixed values).
LEGAL_FORMS = ("주식회사", "유한회사", "사단법인", "재단법인", "의료법인", "학교법인", "사회복지법인", "(주)", "(유)", "(사)", "(재)", "(의)")
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def squeeze(text: Column) -> Column:
    """All white space removed."""
    return F.regexp_replace(text, ANY_SPACE, "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def alnum_key(text: Column) -> Column:
    """Letters (Hangul too) and digits only, in lower case."""
    return F.lower(F.regexp_replace(text, r"[^0-9A-Za-z가-힣]", ""))


def org_name_key(name: Column) -> Column:
    """A key for one organisation's differing names: half width, without legal forms and separators,
    in lower case. What stands in brackets is kept."""
    key = F.translate(name, FULL_WIDTH, HALF_WIDTH)
    for form in LEGAL_FORMS:
        key = F.replace(key, F.lit(form), F.lit(""))
    return F.lower(F.regexp_replace(key, r"[\s 　﻿·ㆍ,.()\[\]{}'\"_/&-]+", ""))


def url_key(url: Column) -> Column:
    """A url that equal pages share: lower-case host without www. and default port, no scheme, no
    slash at the end, no fragment; the query stays. What is no url is trimmed."""
    rest = F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(.*)$", 1)
    host = F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    tail = F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, r"^[^/?#]*(.*)$", 1), "#.*$", ""), "/+$", "")
    return F.when(rest != "", F.concat(host, tail)).otherwise(F.trim(url))


def without_session(url: Column) -> Column:
    """Session ids and campaign marks cut out of a url as text, nothing re-encoded."""
    out = F.regexp_replace(url, r"(?i);jsessionid=[^?#]*", "")
    out = F.regexp_replace(out, r"(?i)([?&])(jsessionid|phpsessid|sid|utm_[a-z]+)=[^&#]*", "$1")
    return F.regexp_replace(F.regexp_replace(out, r"([?&])&+", "$1"), r"[?&]+(#|$)", "$1")


def strip_tags(markup: Column) -> Column:
    """Tags with ASCII names removed; ``<물리치료사>`` stays, as it is text."""
    return F.regexp_replace(markup, r"</?[A-Za-z][^>]*>|<!--[^>]*-->", "")


def decode_entities(text: Column, passes: int = 3) -> Column:
    """The five common references decoded, repeatedly for text that was encoded again and again."""
    for _ in range(passes):
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            text = F.replace(text, F.lit(name), F.lit(char))
    return text


#: What is redacted, in this order: a pattern, its replacement, and what a text must hold one of for
#: it to match. Patterns over long runs begin only where a run or a match ends, and give nothing back.
SECRETS = (
    (r"(?<![A-Za-z0-9_])(?:[Bb]earer|BEARER)\s++[A-Za-z0-9._~+/=-]++", "[token]", ("earer", "EARER")),
    (r"(?<![A-Za-z0-9_])eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+", "[token]", ("eyJ",)),
    (
        r"(?<![A-Za-z0-9_])((?:api[_-]?key|apikey|secret|token|password|passwd|cookie)[\"']?\s*+[:=]\s*+)[\"']?[^\s\"',;&]++[\"']?",
        "$1[secret]",
        ("key", "secret", "token", "passw", "cookie"),
    ),
    (r"(https?://)[^\s/@:]++:[^\s/@]++@", "$1[login]@", ("://",)),
    (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++", "[mail]", ("@",)),
    (r"[0-9]{6}-[1-8][0-9]{6}", "[id]", ("-",)),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[ip]", (".",)),
    (r"\+?[0-9][0-9() -]{7,}[0-9]", "[phone]", ()),
    (r"(?:\G|(?<![A-Za-z0-9_-]))[A-Za-z0-9_-]{32,}+", "[token]", ()),
)


def redact(text: Column, limit: int | None = None) -> Column:
    """Tokens, secrets in fields, logins in urls, mail addresses, id numbers, ip addresses, telephone
    numbers and long tokens replaced, then cut at ``limit`` code points: redaction comes first, so
    no half secret survives the cut."""
    for pattern, label, needs in SECRETS:
        done = F.regexp_replace(text, pattern, label)
        if needs:
            some = F.contains(text, F.lit(needs[0]))
            for word in needs[1:]:
                some = some | F.contains(text, F.lit(word))
            done = F.when(some, done).otherwise(text)
        text = done
    return text if limit is None else F.substring(text, 1, limit)


def string_hash(text: Column) -> Column:
    """The signed 32-bit hash ``h * 31 + unit`` over UTF-16 units."""
    points = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    units = F.flatten(
        F.transform(
            points,
            lambda p: F.when(p < 0x10000, F.array(p)).otherwise(
                F.array(F.floor((p - 0x10000) / 0x400) + 0xD800, (p - 0x10000) % 0x400 + 0xDC00)
            ),
        )
    )
    folded = F.aggregate(units, F.lit(0).cast("long"), lambda h, u: (h * 31 + u) % (1 << 32))
    return F.when(folded >= 1 << 31, folded - (1 << 32)).otherwise(folded)


def posting_id(key: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.abs(string_hash(key)).cast("string"))


def visit_token(salt: str, *parts: Column) -> Column:
    """An unlinkable daily key: 32 hexadecimal digits of SHA-256 over the joined parts."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(salt), *[p.cast("string") for p in parts]), 256), 1, 32)


def topic_particle(word: Column, closed: str = "은", open_: str = "는") -> Column:
    """The particle that follows a word, by whether its last Hangul syllable ends in a consonant."""
    last = F.ascii(F.substring(word, -1, 1))
    ends = (last >= 0xAC00) & (last <= 0xD7A3) & ((last - 0xAC00) % 28 > 0)
    return F.concat(word, F.when(ends, closed).otherwise(open_))


def loose_int(text: Column) -> Column:
    """The digits and sign of a text as a number ("3명" is 3), else null."""
    return F.expr("1") * F.regexp_replace(text, "[^0-9-]", "").try_cast("int")


def strict_int(text: Column) -> Column:
    """A number only where the whole text is one, with or without thousands separators."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit(""))
    return F.when(plain.rlike("^-?[0-9]+$"), plain.try_cast("int"))


def says_yes(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("y", "yes", "예", "o", "true", "1")


#: Elements whose end is a line's end in plain text (fixed values).
LINE_ENDS = "p|div|br|li|tr|h[1-6]|table|ul|ol|section|article|header|footer|dd|dt"


def decode_all(text: Column, passes: int = 5) -> Column:
    """Named, decimal and hexadecimal references decoded, again while that changes something, at most
    ``passes`` times. A number that is no character stays as it is."""

    def once(t: Column) -> Column:
        for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " ")):
            t = F.replace(t, F.lit(name), F.lit(char))
        number = lambda m: F.when(m.rlike("^&#[xX]"), F.conv(F.regexp_extract(m, "^&#[xX]([0-9a-fA-F]+);", 1), 16, 10)).otherwise(F.regexp_extract(m, "^&#([0-9]+);", 1)).try_cast("long")
        valid = lambda n: n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        char = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        found = F.array_distinct(F.regexp_extract_all(t, F.lit("&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});"), F.lit(0)))
        t = F.aggregate(found, t, lambda s, m: F.when(valid(number(m)), F.replace(s, m, char(number(m)))).otherwise(s))
        return F.replace(t, F.lit("&amp;"), F.lit("&"))

    # the passes run over a text only while it changes
    step = lambda s, _: F.when(s["more"], F.struct(once(s["t"]).alias("t"), (once(s["t"]) != s["t"]).alias("more"))).otherwise(s)
    start = F.struct(text.alias("t"), F.contains(text, F.lit("&")).alias("more"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), start, step, lambda s: s["t"])


def html_to_text(markup: Column) -> Column:
    """The text of markup with its line breaks: without scripts, styles, comments and control
    characters, blocks on lines of their own, white space within a line as one space, no empty lines."""
    out = F.regexp_replace(markup, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    out = F.regexp_replace(out, r"[\t\n\r\x0B\f]+", " ")
    out = F.regexp_replace(out, rf"(?i)</?(?:{LINE_ENDS})(?:\s[^>]*)?/?>", "\n")
    out = F.regexp_replace(strip_tags(out), r"[\x00-\x09\x0B-\x1F\x7F]", "")
    out = F.replace(decode_entities(out, 1), F.lit(" "), F.lit(" "))
    lines = F.transform(F.split(out, "\n"), lambda x: F.trim(F.regexp_replace(x, " +", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


#: Long names of provinces with their short ones, longest first where one begins another (fixed values).
PROVINCES = (
    ("서울특별시", "서울"), ("부산광역시", "부산"), ("대구광역시", "대구"), ("인천광역시", "인천"), ("광주광역시", "광주"),
    ("대전광역시", "대전"), ("울산광역시", "울산"), ("세종특별자치시", "세종"), ("경기도", "경기"), ("강원특별자치도", "강원"),
    ("강원도", "강원"), ("충청북도", "충북"), ("충청남도", "충남"), ("전북특별자치도", "전북"), ("전라북도", "전북"),
    ("전남광주통합특별시", "전남광주"), ("전라남도", "전남"), ("경상북도", "경북"), ("경상남도", "경남"), ("제주특별자치도", "제주"),
)
#: Districts that tell the merged province's city from its rest (fixed values).
CITY_DISTRICTS = "동구|서구|남구|북구|광산구"


def province_of(office: Column, above: Column | None = None) -> Column:
    """The short name of the province that an office (or the one above it) is of: by the beginning of
    its name, ``전국`` for a central one, ``모름`` where neither says."""
    above = office if above is None else above
    out = F.when(F.lit(False), "")
    for long, short in PROVINCES:
        out = out.when(above.startswith(long) | office.startswith(long), short)
    central = r"(부|처|청|위원회|정부산하기관및위원회)$"
    return out.when(above.rlike(central) | F.substring_index(office, " ", 1).rlike(central), "전국").otherwise("모름")


def region_text(text: Column) -> Column:
    """Comma-separated regions with short provinces and single spaces; the merged province is told by
    its districts."""

    def short(part: Column) -> Column:
        out = F.regexp_replace(F.trim(part), r"\s+", " ")
        out = F.regexp_replace(out, rf"^전남광주(통합특별시)?\s*({CITY_DISTRICTS})(?![가-힣])", "광주 $2")
        out = F.regexp_replace(out, r"^전남광주(통합특별시)?\s*", "전남 ")
        for long, name in (("충청북", "충북"), ("충청남", "충남"), ("전라북", "전북"), ("전라남", "전남"), ("경상북", "경북"), ("경상남", "경남")):
            out = F.regexp_replace(out, rf"^{long}(특별자치도|도)?\s*", f"{name} ")
        out = F.regexp_replace(out, r"^(경기|강원|제주|전북)(특별자치도|도)?\s*", "$1 ")
        out = F.regexp_replace(out, r"^(서울|부산|대구|인천|광주|대전|울산)(특별시|광역시)\s*", "$1 ")
        return F.trim(F.regexp_replace(out, r"^세종특별자치시\s*", "세종 "))

    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), short), lambda x: x != "")
    return F.array_join(parts, ", ")


def address_parts(address: Column) -> tuple[Column, Column, Column]:
    """The first two words of an address, and its district only where it is one by its ending."""
    words = F.split(F.trim(address), r"\s+")
    first, second = (F.nullif(F.get(words, F.lit(i)), F.lit("")) for i in (0, 1))
    return first, second, F.when(second.rlike("(시|군|구)$"), second)


def source_of(key: Column, bare: str = "AL", folded: tuple[str, ...] = ("WN",)) -> Column:
    """The two-letter source of an id by the letters it begins with; ids without letters have one of
    their own."""
    letters = F.upper(F.regexp_extract(key, "^[A-Za-z]+", 0))
    out = F.when(letters == "", bare)
    for start in folded:
        out = out.when(letters.startswith(start), start)
    return out.otherwise(F.substring(letters, 1, 2))


#: Legal forms, single-letter forms and marks that are not shown with a name (fixed values).
SHOWN_WITHOUT = (
    r"[(（]\s*[㐀-䶿一-鿿]+\s*[)）]",
    r"[㈜㈐㈑㈒㈓㈔]",
    r"\(\s*(?:주|유|의|재|사)\s*\)|주식회사|유한회사|유한책임회사|합자회사|의료법인|사회복지법인|사단법인|재단법인|학교법인|특수법인|영농조합법인",
    r"[㐀-䶿一-鿿]",
    r"[★※【】◇◆□■○●▲▼〔〕\[\]]",
)


def shown_name(name: Column) -> Column:
    """An organisation's name as it is shown: without legal forms, Chinese characters and marks, unless
    two letters or fewer would be left."""
    whole = F.trim(F.coalesce(name, F.lit("")))
    out = whole
    for i, pattern in enumerate(SHOWN_WITHOUT):
        out = F.regexp_replace(out, pattern, "" if i in (0, 3) else " ")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    return F.when(F.length(out) <= 2, whole).otherwise(out)


def listed_in_brackets(title: Column, commas: int = 2) -> Column:
    """The first bracket of a title that lists several things, or null."""
    inside = F.regexp_extract_all(title, F.lit("[(（]([^)）]*)[)）]"), F.lit(1))
    return F.get(F.filter(inside, lambda x: F.length(x) - F.length(F.translate(x, ",，", "")) >= commas), F.lit(0))


def split_outside_brackets(text: Column, separators: str = ",，") -> Column:
    """The parts of a text between separators (single characters) that are in no bracket, brackets
    nesting; trimmed, none empty."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("parts"))

    def step(s, c):
        depth = F.when(c.isin("(", "（", "["), s["depth"] + 1).when(c.isin(")", "）", "]"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        cut = c.isin(*separators) & (s["depth"] == 0)
        return F.struct(
            depth.alias("depth"),
            F.when(cut, "").otherwise(F.concat(s["part"], c)).alias("part"),
            F.when(cut, F.concat(s["parts"], F.array(s["part"]))).otherwise(s["parts"]).alias("parts"),
        )

    parts = F.aggregate(F.split(text, ""), start, step, lambda s: F.concat(s["parts"], F.array(s["part"])))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def sentences(text: Column) -> Column:
    """The sentences of a text: cut behind a full stop, question or exclamation mark and white space."""
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda x: x != "")


#: Titles of pages that are no content, and traces of failed applications and databases (fixed values).
LOGIN_TITLES = ("로그인", "회원 로그인", "login", "log in", "sign in", "member login")
BLOCK_TITLES = ("403 forbidden", "forbidden", "access denied", "403 access denied", "접근이 거부되었습니다", "접근 권한이 없습니다", "접근이 제한되었습니다", "attention required! | cloudflare", "just a moment...")
ERROR_TITLES = ("400 bad request", "404 not found", "not found", "500 internal server error", "internal server error", "502 bad gateway", "503 service unavailable", "service unavailable", "504 gateway time-out", "504 gateway timeout", "runtime error", "페이지를 찾을 수 없습니다", "오류가 발생했습니다")
APP_TRACES = r"(?s)\b(?:Fatal error|Parse error)\s*:\s*\S.{0,1200}?\bon line\s+\d+|Server Error in '[^']{0,200}' Application"
DB_TRACES = r"You have an error in your SQL syntax|\bUncaught mysqli_sql_exception\b|\bSQLSTATE\[[0-9A-Z]{5}\]\s*:|\bORA-\d{5}\s*:"


def error_signature(title: Column, text: Column, has_password: Column) -> Column:
    """What kind of failure a page shows, or null: by its whole title, then by traces in its text. A
    login's title counts only with a field for a password."""
    t = F.lower(title)
    return (
        F.when(t.isin(*LOGIN_TITLES) & has_password, "login")
        .when(t.isin(*BLOCK_TITLES), "blocked")
        .when(t.isin(*ERROR_TITLES), "error")
        .when(text.rlike(APP_TRACES), "application trace")
        .when(text.rlike(DB_TRACES), "database trace")
    )


def without_parts(values: Column) -> Column:
    """The elements that are part of no other element, in order, each once."""
    each = F.array_distinct(values)
    return F.filter(each, lambda x: ~F.exists(each, lambda y: (y != x) & F.contains(y, x)))


def hashtag(name: Column) -> Column:
    """A name as a tag: without legal forms, brackets and what stands in them, blanks and marks."""
    return F.concat(F.lit("#"), F.regexp_replace(F.regexp_replace(shown_name(name), r"[(（][^)）]*[)）]", ""), r"[^0-9A-Za-z가-힣]", ""))


#: Owners' names before an institution's, dropped only where an institution's noun follows (fixed values).
OWNER = r"^\s*[가-힣A-Za-z0-9]{1,14}(?:의료재단|복지재단|의료법인|복지법인|재단|학원|법인)\s+"
INSTITUTION = "병원|의원|요양원|의료원|센터|클리닉"
#: Public institutions whose names may begin with their province (fixed values).
PROVINCIAL_TAIL = "(?:보건소|보건지소|보건의료원|치매안심센터|치매센터)$"


def institution_key(name: Column, drop_province: bool = False) -> Column:
    """A key for an institution's differing names: half width, without legal forms, without its owner's
    name where an institution's follows, what stands in brackets kept, no separators, lower case. On
    demand without the province that a public institution's name begins with."""
    key = F.replace(F.translate(F.coalesce(name, F.lit("")), FULL_WIDTH + "　", HALF_WIDTH + " "), F.lit("("), F.lit(" ("))
    for form in LEGAL_FORMS:
        spaced = form.replace("(", " (") if form.startswith("(") else form
        key = F.replace(key, F.lit(spaced), F.lit(" "))
    owned = key.rlike(rf"{OWNER}.*(?:{INSTITUTION})")
    key = F.when(owned, F.regexp_replace(key, OWNER, "")).otherwise(key)
    key = F.lower(F.regexp_replace(key, r"[\s·・,()\[\]‐‑–—\-/]", ""))
    if not drop_province:
        return key
    provinces = "|".join(long for long, _ in PROVINCES)
    return F.when(key.rlike(PROVINCIAL_TAIL), F.regexp_replace(key, f"^(?:{provinces})", "")).otherwise(key)


def code_point_hash(text: Column) -> Column:
    """The unsigned 32-bit hash ``h * 31 + point`` over code points."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: (h * 31 + F.ascii(c)) % (1 << 32))
