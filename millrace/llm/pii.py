"""Personal data: patterns, and information-theoretic sanitisation of the terms around them.

Patterns find the protected entities of a text (addresses and numbers). The corpus then tells which
terms give them away: a term's co-occurrence with an entity, over different texts, estimates the
probability of the entity given the term and, against the entity's own probability, how many bits
the term discloses. Terms beyond both thresholds become spans in the texts that hold the entity, and
are generalised or, where they all but name it, removed.

Entities share evidence at two more levels, their group (the domain of an address, the network of an
ip, the issuer of a card, the region of a phone) and their kind: a term may tell these though no
single entity comes often enough. As these are tried for many terms, the lower bound of an interval
takes the place of their estimated probability.

Everything is DataFrame functions. The co-occurrence table has rows only for texts with an entity;
of the whole corpus, the terms that may disclose something are counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import joined_to_groups, unpacked, written

#: The kinds of the patterns, in the order in which spans of one start are listed, and of the terms.
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

#: Written so that a failing start costs no more than a few characters: a match can begin only where
#: a run of its characters does, or where the match before ended. Nothing that follows a possessive
#: part could take a character back, so the matches are those of the plain patterns
#: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+``, ``[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)``,
#: ``[0-9]([\x20-]?[0-9])+`` (here with its 14 to 19 digits) and ``\+[0-9][\x20().0-9-]+[0-9]``.
PATTERNS = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: What a text must contain for a pattern to match.
NEEDS = ("@", ".", None, "+")
WORD = r"\p{L}++"
#: Lengths that are summed together when places are worked out.
BLOCK = 256
SPAN = "struct<start:bigint,kind:int,end:bigint,value:string,context:string>"


@dataclass(frozen=True)
class Disclosure:
    """``context``: characters on each side of an entity; a term has ``letters`` letters at least
    and occurs in ``support`` different texts with the entity, or contexts of it, at least. It is a span if the
    probability of the entity given the term reaches ``certainty`` and tells ``bits`` more than
    the entity's own probability; from ``removal`` on it is removed, below it generalised. For a group
    or a kind of entities the probability is the lower bound of its interval of ``z`` standard errors."""

    context: int = 100
    letters: int = 3
    support: int = 3
    certainty: float = 0.5
    bits: float = 3.0
    removal: float = 0.9
    z: float = 1.96


#: Disclosing terms, and texts that hold them, up to which they are broadcast.
BROADCAST_ROWS = 100_000


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, x: s + x)


def _before(lengths: str, blocks: str, i: Column) -> Column:
    """The sum of the first ``i`` lengths, with the help of the sums of whole blocks."""
    whole = F.floor(i / BLOCK).cast("int")
    return _sum(F.slice(F.col(blocks), F.lit(1), whole)) + _sum(
        F.slice(F.col(lengths), whole * BLOCK + 1, i - whole * BLOCK)
    )


def _with_matches(df: DataFrame, text: str, name: str, pattern: str, needs: str | None = None) -> DataFrame:
    """Adds, for the matches of a pattern, ``{name}_m`` (the matches), ``{name}_p`` (what lies
    between them), ``{name}_l`` and ``{name}_b`` (lengths of a gap and its match, and block sums)."""
    none = F.array().cast("array<string>")
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    df = df.withColumn(f"{name}_m", F.when(F.contains(F.col(text), F.lit(needs)), found).otherwise(none) if needs else found)
    some = F.size(f"{name}_m") > 0
    df = df.withColumn(f"{name}_p", F.when(some, F.split(F.col(text), pattern, -1)).otherwise(none))
    both = F.zip_with(f"{name}_p", f"{name}_m", lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))
    df = df.withColumn(f"{name}_l", both)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(f"{name}_l") / BLOCK).cast("int")),
        lambda b: _sum(F.slice(F.col(f"{name}_l"), b * BLOCK + 1, F.lit(BLOCK))),
    )
    return df.withColumn(f"{name}_b", F.when(some, blocks).otherwise(F.array().cast("array<bigint>")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _span(i: int, context: int):
    """The span of a match (its text and ordinal) of kind ``i``."""
    kind = KINDS[i]
    gap = lambda k: F.get(f"{kind}_p", k)

    def span(m, k):
        end = _before(f"{kind}_l", f"{kind}_b", k + 1)
        around = F.concat(F.right(gap(k), F.lit(context)), F.lit("\n"), F.left(gap(k + 1), F.lit(context)))
        return F.struct(
            (end - F.length(m)).alias("start"),
            F.lit(i).alias("kind"),
            end.alias("end"),
            m.alias("value"),
            around.alias("context"),
        )

    return span


def _validity(kind: str):
    return lambda s: _valid(kind, s["value"])


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
        low = lambda x: F.right(part(x), F.lit(3)).cast("int") <= 255
        return F.forall(F.split(value, r"\."), lambda x: (F.length(part(x)) <= 3) & low(x))
    if kind == "card":
        digit = lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
            2 * d.cast("int") - F.when(d.cast("int") > 4, 9).otherwise(0)
        )
        return _sum(F.transform(F.split(F.reverse(_digits(value)), ""), digit).cast("array<bigint>")) % 10 == 0
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def with_base_spans(df: DataFrame, text: str, context: int) -> DataFrame:
    """Adds ``base``: the spans of the patterns in the column ``text`` (never null), by start and
    kind, each with its text and the ``context`` characters on both sides of it."""
    columns = df.columns
    spans = []
    for i, (kind, pattern, needs) in enumerate(zip(KINDS, PATTERNS, NEEDS, strict=True)):
        df = _with_matches(df, text, kind, pattern, needs)
        found = F.filter(F.transform(f"{kind}_m", _span(i, context)), _validity(kind))
        none = F.array().cast(f"array<{SPAN}>")
        spans.append(F.when(F.size(f"{kind}_m") > 0, found).otherwise(none))
    return df.select(*columns, F.array_sort(F.concat(*spans)).alias("base"))


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def entities_of(span: Column) -> Column:
    """What a span is evidence of, as an array of (level, entity): the entity itself (its kind and
    letters or digits), its group, and its kind."""
    value, digits, kind = F.lower(span["value"]), _digits(span["value"]), span["kind"]
    own = F.when(kind <= 1, value).otherwise(digits)
    group = (
        F.when(kind == 0, F.substring_index(value, "@", -1))
        .when(kind == 1, F.substring_index(value, ".", 3))
        .when(kind == 2, F.left(digits, F.lit(6)))
        .otherwise(F.left(digits, F.lit(5)))
    )
    levels = (own, group, F.lit(""))
    return F.array(*[F.struct(F.lit(i).alias("level"), F.xxhash64(F.lit(i), kind, v).alias("entity")) for i, v in enumerate(levels)])


def _lower_bound(p: Column, n: Column, z: float) -> Column:
    """The lower end of Wilson's interval for a share ``p`` of ``n``."""
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _different(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """``texts`` (of, text) without copies; only those in ``repeated`` (of) are shuffled, while these
    are few."""
    n = repeated.count()
    if not n:
        return texts
    if n > BROADCAST_ROWS:
        return texts.dropDuplicates(["of"])
    repeated = F.broadcast(repeated)
    once = texts.join(repeated, "of", "left_semi").dropDuplicates(["of"])
    return texts.join(repeated, "of", "left_anti").unionAll(once)


def disclosing(texts: DataFrame, held: DataFrame, options: Disclosure = Disclosure()) -> DataFrame:
    """(entity, n_entity, term, certainty, bits) of the terms that exceed the thresholds. ``texts``:
    the columns of (which is equal for equal texts) and text of all rows. ``held``: (of, level,
    entity, context) of the entities that they hold.

    A term occurs with an entity wherever a text holds both, however far apart. All counts are of
    different texts, so copies are no evidence for a term nor against it; one text supports a term
    as well that has it in enough different contexts of the entity itself.
    """
    held = held.select("of", "level", "entity", F.lower("context").alias("context")).distinct()
    contexts = held.filter("level = 0").select("entity", "context").distinct()
    pairs = held.select("of", "level", "entity").distinct()
    often = written(
        pairs.groupBy("level", "entity")
        .agg(F.count("*").alias("n_entity"))
        .join(contexts.groupBy("entity").agg(F.count("*").alias("n_contexts")), "entity", "left")
        .filter(F.greatest("n_entity", "n_contexts") >= options.support)
        .select("level", "entity", "n_entity"),
        "pii-often",
    )
    words = _words(options)
    pairs = written(joined_to_groups(pairs.select("of", "entity"), often, ["entity"], "n_entity"), "pii-pairs")
    ids = pairs.select("of").distinct()
    few = ids.count() <= BROADCAST_ROWS
    own = texts.join(F.broadcast(ids) if few else ids, "of", "left_semi").select("of", "text").distinct()
    by_text = (
        own.select("of", words(F.lower("text")).alias("words"))
        .join(pairs, "of")
        .select("level", "entity", "n_entity", F.explode("words").alias("term"))
        .groupBy("level", "entity", "n_entity", "term")
        .agg(F.count("*").alias("n_both"))
    )
    by_context = (
        joined_to_groups(contexts, often, ["entity"], "n_entity")
        .select("entity", F.explode(words(F.col("context"))).alias("term"))
        .groupBy("entity", "term")
        .agg(F.count("*").alias("n_contexts"))
        .filter(F.col("n_contexts") >= options.support)
    )
    joint = written(
        by_text.join(by_context, ["entity", "term"], "left")
        .filter((F.col("n_both") >= options.support) | F.col("n_contexts").isNotNull())
        .select("level", "entity", "n_entity", "term", "n_both"),
        "pii-joint",
    )
    if joint.isEmpty():
        return joint.select("entity", "n_entity", "term", F.lit(0.0).alias("certainty"), F.lit(0.0).alias("bits"))
    repeats = written(texts.groupBy("of").agg(F.count("*").alias("n")), "pii-repeats")
    n_texts = repeats.count()
    # all words are counted in place first, so that what meets the candidates is a vocabulary
    each = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("term")
    counts = _different(texts.select("of", "text"), repeats.filter("n > 1").select("of")).select(each)
    counts = counts.groupBy("term").agg(F.count("*").alias("n_term"))
    share = F.col("n_both") / F.col("n_term")
    certainty = F.when(F.col("level") == 0, share).otherwise(_lower_bound(share, F.col("n_term"), options.z))
    bits = F.log2(certainty / (F.col("n_entity") / F.lit(n_texts)))
    return (
        joint.join(counts, "term")
        .select("entity", "n_entity", "term", certainty.alias("certainty"), bits.alias("bits"))
        .filter((F.col("certainty") >= options.certainty) & (F.col("bits") >= options.bits))
    )


def _words(options: Disclosure):
    """The different words of a text that may be terms."""
    return lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(rf"\p{{L}}{{{options.letters},}}+"), F.lit(0)))


def terms_held(texts: DataFrame, held: DataFrame, told: DataFrame, options: Disclosure) -> DataFrame:
    """(of, term, certainty): the disclosing terms (``told``, written) that the texts have of the entities
    that they hold (``held``: of, entity). A text's own words are looked up, so an entity of many
    texts and terms makes no rows but those that are there."""
    few = told.count() <= BROADCAST_ROWS
    near = lambda df: F.broadcast(df) if few else df
    ids = written(held.join(near(told.select("entity").distinct()), "entity", "left_semi"), "pii-held")
    some = ids.select("of").distinct()
    own = texts.join(F.broadcast(some) if some.count() <= BROADCAST_ROWS else some, "of", "left_semi")
    each = own.select("of", F.explode(_words(options)(F.lower("text"))).alias("term"))
    there = each.join(near(told.select("term").distinct()), "term", "left_semi").distinct()
    met = there.join(ids, "of").join(near(told.select("entity", "term", "certainty")), ["entity", "term"])
    return met.groupBy("of", "term").agg(F.max("certainty").alias("certainty"))


def with_spans(
    df: DataFrame,
    text_col: str = "text",
    options: Disclosure = Disclosure(),
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns in ``carry`` (all) of ``df`` with ``base`` and ``spans`` added: the spans of the
    patterns, and these with the disclosing terms (kind 4), by start and kind. A span has start,
    kind (its place in KINDS), end (exclusive; both count code points) and value; a term's context
    is ``removed`` or ``generalised``.

    A null or empty text has no spans; equal texts have equal spans; an empty table gives an empty
    result; added columns replace input columns of the same name.
    """
    carry = df.columns if carry is None else carry
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    ).withColumn("of", F.md5("text"))
    # written, as a filter on the spans would otherwise be worked out again from the patterns
    found = written(with_base_spans(rows, "text", options.context).select("row", "of", "base"), "pii-spans")
    held = written(
        found.select("of", F.explode("base").alias("span"))
        .select("of", F.explode(entities_of(F.col("span"))).alias("e"), F.col("span.context").alias("context"))
        .select("of", "e.level", "e.entity", "context")
        .distinct(),
        "pii-entities",
    )
    told = written(disclosing(rows.select("of", "text"), held, options), "pii-terms")
    if told.isEmpty():
        return unpacked(found.withColumn("spans", F.col("base")), carry, ["base", "spans"])
    pair = F.struct("term", "certainty")
    found_terms = terms_held(rows.select("of", "text"), held.select("of", "entity").distinct(), told, options)
    terms = written(found_terms.groupBy("of").agg(F.map_from_entries(F.collect_list(pair)).alias("terms")), "pii-texts")
    few = terms.count() <= BROADCAST_ROWS
    near = lambda table: F.broadcast(table) if few else table
    texts = rows.select("of", "text").join(near(terms), "of").dropDuplicates(["of"])
    added = written(texts_with_terms(texts, options), "pii-added")
    found = found.join(near(added), "of", "left")
    free = lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    more = F.coalesce(F.filter("added", free), F.array().cast(f"array<{SPAN}>"))
    return unpacked(found.withColumn("spans", F.array_sort(F.concat("base", more))), carry, ["base", "spans"])


def texts_with_terms(texts: DataFrame, options: Disclosure) -> DataFrame:
    """(of, text, terms), with terms a map of disclosing terms to certainties, to (of, added): the
    spans of the terms."""

    def span(m, k):
        end = _before("word_l", "word_b", k + 1)
        sure = F.try_element_at("terms", F.lower(m))
        what = F.when(sure >= options.removal, "removed").when(sure.isNotNull(), "generalised")
        start = end - F.length(m)
        return F.struct(
            start.alias("start"), F.lit(len(KINDS)).alias("kind"), end.alias("end"), m.alias("value"), what.alias("context")
        )

    words = _with_matches(texts, "text", "word", WORD)
    return words.select("of", F.filter(F.transform("word_m", span), lambda s: s["context"].isNotNull()).alias("added"))


def sanitised(df: DataFrame, text_col: str = "text", options: Disclosure = Disclosure()) -> DataFrame:
    """``df`` with ``text_col`` sanitised: entities become ``[EMAIL]``, ``[IP]``, ``[CARD]`` or
    ``[PHONE]``, disclosing terms ``[TERM]`` or nothing. Spans that overlap become one. A null text
    stays null."""
    columns = df.columns
    others = [F.col(f"`{c}`") for c in columns if c != text_col] or [F.lit(0).alias("none")]
    rows = df.select(F.struct(*others).alias("row"), F.col(f"`{text_col}`").alias("text"))
    rows = with_spans(rows, "text", options, carry=["row", "text"])
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, TERM)])
    label = lambda s: F.when((s["kind"] == len(KINDS)) & (s["context"] == "removed"), "").otherwise(F.get(labels, s["kind"]))
    part = "array<struct<start:bigint,end:bigint,label:string>>"

    def merged(acc, s):
        last = F.try_element_at(acc, F.lit(-1))
        one = F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("label"))
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["label"].alias("label"))
        # the last part is replaced where the span overlaps it
        return F.when(
            F.coalesce(last["end"] > s["start"], F.lit(False)),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer)),
        ).otherwise(F.concat(acc, F.array(one)))

    rows = rows.withColumn("parts", F.aggregate("spans", F.array().cast(part), merged))
    end = lambda k: F.coalesce(F.get("parts", k).getField("end"), F.lit(0).cast("long"))
    kept = F.transform(
        "parts",
        lambda s, k: F.concat(
            F.substring(F.col("text"), (F.when(k > 0, end(k - 1)).otherwise(0) + 1).cast("int"), (s["start"] - F.when(k > 0, end(k - 1)).otherwise(0)).cast("int")),
            s["label"],
        ),
    )
    tail = F.substring(F.col("text"), (end(F.size("parts") - 1) + 1).cast("int"), F.length("text"))
    clean = F.when(F.size("parts") > 0, F.concat(F.array_join(kept, ""), tail)).otherwise(F.col("text"))
    rows = rows.withColumn("clean", clean)
    return rows.select(
        *[F.col("clean").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns]
    )
