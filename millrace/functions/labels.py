"""Labels read out of names, tags and short texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import split_outside_brackets

#: Marks of what is required and what is only preferred (fixed values).
REQUIRED_MARKS = ("필수", "required", "must")
PREFERRED_MARKS = ("우대", "preferred", "plus")


def longest_hit(text: Column, words: Sequence[str]) -> Column:
    """The longest word of a dictionary that a text contains; null for none."""
    pattern = "|".join(sorted((_quoted(w) for w in words), key=lambda w: (-len(w), w)))
    hits = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    longest = F.reduce(hits, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return F.nullif(longest, F.lit(""))


def _quoted(word: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+?^$|" else c for c in word)


def only_one(values: Column) -> Column:
    """The one different value of an array; null if there are none or several."""
    kinds = F.array_distinct(F.array_compact(values))
    return F.when(F.size(kinds) == 1, kinds[0])


def partition_tags(tags: Column, *groups: Sequence[str]) -> list[Column]:
    """The tags of each group and then all others, each in the order that they came in."""
    known = [F.array(*[F.lit(t) for t in g]) for g in groups]
    within = lambda group: lambda t: F.array_contains(group, t)
    return [*[F.filter(tags, within(k)) for k in known], F.filter(tags, lambda t: ~F.array_contains(F.concat(*known), t))]


def decoded(code: Column, meanings: Mapping[str, str]) -> tuple[Column, Column]:
    """The meaning of a code (the code itself where it is unknown), and whether it is known."""
    table = F.create_map(*[F.lit(x) for pair in meanings.items() for x in pair])
    found = F.try_element_at(table, code)
    return F.coalesce(found, code), found.isNotNull()


def prefix_label(text: Column, prefixes: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first prefix that a text starts with."""
    out = F.when(F.lit(False), "")
    for prefix, label in prefixes:
        out = out.when(text.startswith(prefix), label)
    return out.otherwise(otherwise)


def single_licence(wanted: Column, names: Sequence[str], text: Column) -> Column:
    """``wanted`` narrowed from both to the one licence that a text names, unless it only prefers."""
    held = F.array_compact(F.array(*[F.when(text.contains(n), n) for n in names]))
    narrow = (wanted == "both") & (F.size(held) == 1) & ~F.exists(F.array(*map(F.lit, PREFERRED_MARKS)), lambda m: text.contains(m))
    return F.when(narrow, held[0]).otherwise(wanted)


#: What stands behind a mark to say that there is no such condition (fixed values).
NONE_SUCH = r"(?:해당\s*(?:사항)?\s*)?(?:없음|없습니다|무관|none)\.?"


def required_and_preferred(text: Column, separators: str = ",\n;/") -> tuple[Column, Column]:
    """The pieces of a list of conditions that are required, and those that are preferred. A mark
    before a piece changes what follows; one at a piece's end moves that piece alone. Marks and
    separators within brackets are none, and a mark with "none" behind it says nothing: neither it nor
    what follows becomes preferred. What has both marks stays required."""
    marks = lambda ms: "|".join(ms)
    pieces = split_outside_brackets(text, separators)
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(False).alias("preferred"), none.alias("must"), none.alias("may"))
    word = r"\s*(?:사항|조건|자격|요건)?"
    lead = rf"(?i)^[\s\[(（○●•▪■·-]*({{}}){word}[\])）]?\s*(?:[:：-]\s*|\s+|$)"
    must_lead, may_lead = lead.format(marks(REQUIRED_MARKS)), lead.format(marks(PREFERRED_MARKS))
    tail = rf"(?i)\s*({marks(PREFERRED_MARKS)})[.\s]*$"

    def step(s, piece):
        leads_may, leads_must = piece.rlike(may_lead), piece.rlike(must_lead)
        rest = F.trim(F.regexp_replace(F.regexp_replace(piece, may_lead, ""), must_lead, ""))
        empty = (leads_may | leads_must) & rest.rlike(rf"(?i)^{NONE_SUCH}$")
        tail_may = piece.rlike(tail) & ~leads_may & ~rest.rlike(rf"(?i)({marks(REQUIRED_MARKS)})")
        mode = F.when(empty, s["preferred"]).when(leads_may, True).when(leads_must, False).otherwise(s["preferred"])
        bare = F.when(tail_may | mode, F.trim(F.regexp_replace(rest, tail, ""))).otherwise(rest)
        here = F.when(empty | (bare == ""), none).otherwise(F.array(bare))
        may = mode | tail_may
        return F.struct(
            mode.alias("preferred"),
            F.concat(s["must"], F.when(may, none).otherwise(here)).alias("must"),
            F.concat(s["may"], F.when(may, here).otherwise(none)).alias("may"),
        )

    state = F.aggregate(pieces, start, step)
    return state["must"], state["may"]


def complete_or_empty(columns: Sequence[Column]) -> Column:
    """Whether a survey row can be taken: all of its fields are filled, or none of them is."""
    filled = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    return (filled == 0) | (filled == len(columns))


#: Units of money amounts in won, and words for the period that one is paid for (fixed values).
UNITS = {"억": 100_000_000, "만": 10_000, "천": 1_000}
PERIODS = (("시급|시간당", "hour"), ("일급|일당", "day"), ("월급|월|매월", "month"), ("연봉|연|매년", "year"))
LEAST_BARE, LEAST_YEAR = 1_000_000, 10_000_000


def pay_range(text: Column) -> Column:
    """(low, high, period) of a pay text, or null. Of ``200~250만원`` both ends have the unit; a bare
    number counts from a million on; a year's pay under ten million counts only where the text calls
    it one."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    plain = F.regexp_replace(plain, r"([0-9.]+)\s*[~-]\s*([0-9.]+)\s*(억|만|천)", "$1$3~$2$3")
    found = F.regexp_extract_all(plain, F.lit(r"([0-9]+(?:\.[0-9]+)?\s*(?:억|만|천)?)"), F.lit(1))

    def value(x):
        number = F.regexp_extract(x, r"^([0-9.]+)", 1).try_cast("double")
        unit = F.lit(1)
        for name, size in UNITS.items():
            unit = F.when(x.endswith(name), size).otherwise(unit)
        whole = (number * unit).cast("long")
        return F.when((unit > 1) | (whole >= LEAST_BARE), whole)

    amounts = F.slice(F.array_compact(F.transform(found, value)), 1, 2)
    period = F.when(F.lit(False), "")
    for words, name in PERIODS:
        period = period.when(text.rlike(words), name)
    low, high = F.array_min(amounts), F.array_max(amounts)
    period = period.otherwise(F.when(high >= LEAST_YEAR, "year").otherwise("month"))
    return F.when(F.size(amounts) > 0, F.struct(low.alias("low"), high.alias("high"), period.alias("period")))
