"""Quality rules as weak supervision.

Each rule votes good or bad on a document or abstains. Expectation-maximisation over the counts
of vote patterns estimates how accurate each rule is on good and on bad documents, and the
posterior probability of good quality replaces all-must-pass filtering. The features and votes
are DataFrame functions; only the counts of vote patterns (3 to the power of the number of rules
at most, however large the corpus) reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import unpacked, written

SPACES = " \t\n\x0b\f\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÀÑ"

#: Frequent function words of the languages that the corpus is written in (fixed values).
FUNCTION_WORDS = (
    "the of and to in is that for it as with was on are by this be from or have an not at "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "de la que el en y los se del las un por con para una su al lo como más "
    "le les et des est dans qui par pour au sur pas plus ne ce une il sont"
).split()

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN, -1))


def with_features(df: DataFrame, text: Column) -> DataFrame:
    """Adds FEATURES, ``n_lines``, ``n_capitals``, ``n_marks``, ``n_stops`` (sentence ends) and
    ``n_function`` (different function words) to ``df``.

    A word is repeated if a window of three words that covers it occurs twice or more in the
    text. Windows are compared by 64-bit hashes within one document: sorted with their places,
    equal neighbours are repeats, and the places of repeats give the covered words. The cost is
    n log n in the length of a document.
    """
    removed = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    df = df.withColumn("t", F.coalesce(text, F.lit("")))
    df = df.withColumn("w", words_of(F.col("t"))).withColumn(
        "lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(NOT_SPACE))
    )
    df = df.select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        removed(SYMBOLS).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        removed(CAPITALS).cast("long").alias("n_capitals"),
        removed("!?").cast("long").alias("n_marks"),
        removed(".").cast("long").alias("n_stops"),
        F.size(F.array_intersect("w", F.array(*map(F.lit, dict.fromkeys(FUNCTION_WORDS))))).alias("n_function"),
        F.when(
            F.size("w") >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size("w") - 3),
                lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)),
            ),
        )
        .otherwise(F.array().cast("array<bigint>"))
        .alias("grams"),
    ).drop("t", "w", "lines")
    pairs = F.when(
        F.size(F.array_distinct("grams")) < F.size("grams"),
        F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
    ).otherwise(F.array().cast("array<struct<g:bigint,i:int>>"))
    df = df.withColumn("pairs", pairs).drop("grams")
    same = lambda e, k: F.coalesce(F.get("pairs", k).getField("g") == e.getField("g"), F.lit(False))
    places = F.transform(
        F.filter("pairs", lambda e, k: same(e, k - 1) | same(e, k + 1)), lambda e: e.getField("i")
    )
    df = df.withColumn("places", F.sort_array(places)).drop("pairs")
    covered = F.transform("places", lambda p, k: F.least(F.lit(3), F.coalesce(F.get("places", k + 1) - p, F.lit(3))))
    return df.withColumn(
        "n_repeat_words", F.aggregate(covered, F.lit(0).cast("long"), lambda s, x: s + x)
    ).drop("places")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def _vote(good: Column, bad: Column) -> Column:
    """g, b or - (abstains); a rule that cannot be worked out abstains."""
    return F.coalesce(F.when(bad, "b").when(good, "g"), F.lit("-"))


def votes() -> list[Column]:
    """One vote for each rule, over the columns of ``with_features``."""
    words = F.nullif(F.col("n_words"), F.lit(0))
    chars = F.nullif(F.col("word_chars"), F.lit(0))
    symbols = F.col("n_symbols") / words
    length = F.col("word_chars") / words
    lines = F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0))
    repeats = F.col("n_repeat_words") / words
    capitals = F.col("n_capitals") / chars
    marks = F.col("n_marks") / words
    stops = F.col("n_stops") / words
    never = F.lit(False)
    return [
        _vote(symbols < 0.02, symbols > 0.1),
        _vote(F.col("n_function") >= 4, (F.col("n_function") <= 1) & (F.col("n_words") >= MIN_WORDS)),
        _vote(stops.between(0.01, 0.3), stops < 0.002),
        _vote(never, (length < 2) | (length > 14)),
        _vote(never, lines > 0.3),
        _vote(never, repeats > 0.3),
        _vote(never, capitals > 0.4),
        _vote(never, marks > 0.3),
    ]


#: Which of the rules in ``votes`` never vote good.
ONLY_BAD_RULES = (False, False, False, True, True, True, True, True)


@dataclass(frozen=True)
class VoteModel:
    """``prior``: the share of good documents; ``good[j]`` and ``bad[j]``: how often rule j votes
    good, votes bad or abstains (keys g, b and -) on good and on bad documents."""

    prior: float
    good: tuple[dict[str, float], ...]
    bad: tuple[dict[str, float], ...]

    def weights(self) -> list[dict[str, float]]:
        """What each vote of each rule adds to the log-odds of good."""
        return [{v: math.log(g[v] / b[v]) for v in "gb-"} for g, b in zip(self.good, self.bad, strict=True)]

    def log_odds(self, pattern: str) -> float:
        start = math.log(self.prior / (1 - self.prior))
        return start + sum(w[v] for w, v in zip(self.weights(), pattern, strict=True))


#: Beliefs before the data, for rules that vote both ways and for rules that only vote bad. A rule
#: seldom votes bad on a good document; this tells the two classes apart. An estimate is drawn to
#: them with STRENGTH times the weight of the documents, so alike at every size.
BOTH = ({"g": 0.75, "b": 0.02, "-": 0.23}, {"g": 0.25, "b": 0.45, "-": 0.3})
ONLY_BAD = ({"g": 1e-6, "b": 0.02, "-": 0.98}, {"g": 1e-6, "b": 0.3, "-": 0.7})
STRENGTH, GOOD_SHARE = 0.05, 0.8


def fit(
    patterns: dict[str, int], only_bad: tuple[bool, ...], rounds: int = 200, tolerance: float = 1e-9
) -> VoteModel:
    """Expectation-maximisation over counted vote patterns."""
    beliefs = [ONLY_BAD if x else BOTH for x in only_bad]
    model = VoteModel(GOOD_SHARE, tuple(b[0] for b in beliefs), tuple(b[1] for b in beliefs))
    total = sum(patterns.values())
    for _ in range(rounds if total else 0):
        mass = [0.0, 0.0]
        seen = [[dict.fromkeys("gb-", 0.0) for _ in only_bad] for _ in range(2)]
        for pattern in sorted(patterns):
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, model.log_odds(pattern)))))
            for c, n in enumerate((patterns[pattern] * p, patterns[pattern] * (1 - p))):
                mass[c] += n
                for j, vote in enumerate(pattern):
                    seen[c][j][vote] += n
        drawn = [
            tuple(
                {v: (seen[c][j][v] + STRENGTH * (mass[c] + 1e-9) * b[c][v]) / ((1 + STRENGTH) * (mass[c] + 1e-9)) for v in "gb-"}
                for j, b in enumerate(beliefs)
            )
            for c in range(2)
        ]
        new = VoteModel((mass[0] + GOOD_SHARE) / (total + 1), *drawn)
        moved = max(abs(new.log_odds(p) - model.log_odds(p)) for p in patterns)
        model = new
        if moved < tolerance:
            break
    return model


def _pattern_odds(model: VoteModel) -> Column:
    """The log-odds of good of the column ``pattern``."""
    total = F.lit(math.log(model.prior / (1 - model.prior)))
    for j, weight in enumerate(model.weights()):
        vote = F.substring("pattern", j + 1, 1)
        total = total + F.when(vote == "g", weight["g"]).when(vote == "b", weight["b"]).otherwise(weight["-"])
    return total


def _voted(df: DataFrame, text_col: str, carry: list[str]) -> DataFrame:
    """``row`` (the columns in ``carry``), FEATURES, ``base_failed`` and ``pattern`` (a vote for each
    rule) of each row, written: features cost far more than reading them twice."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    marked = with_features(rows, F.col("text"))
    return written(
        marked.select("row", *FEATURES, base_failed().alias("base_failed"), F.concat(*votes()).alias("pattern")), "quality-votes"
    )


def _fitted(voted: DataFrame) -> VoteModel:
    """The vote model of a whole table; at most 3 ** rules counted patterns are collected."""
    counted = voted.groupBy("pattern").count().collect()
    return fit({r["pattern"]: r["count"] for r in counted}, ONLY_BAD_RULES)


def judged(
    df: DataFrame, text_col: str = "text", model: VoteModel | None = None, threshold: float = 0.5, carry: list[str] | None = None
) -> DataFrame:
    """The columns in ``carry`` (all) of ``df`` with FEATURES, ``base_failed``, ``quality`` and
    ``kept`` added.

    ``quality`` is the posterior probability that a document is good; ``kept`` is false where
    the base rules fail and else whether ``quality`` reaches ``threshold``. Without ``model`` it
    is fitted on all of ``df``. A null text is an empty one (no words, so the base rules fail);
    repeated rows are judged alike; an empty table gives an empty result; an added column
    replaces an input column of the same name.
    """
    carry = df.columns if carry is None else carry
    voted = _voted(df, text_col, carry)
    quality = 1 / (1 + F.exp(-_pattern_odds(model or _fitted(voted))))
    out = voted.withColumn("quality", quality).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
    return unpacked(out, carry, [*FEATURES, "base_failed", "quality", "kept"])


def kept_rows(df: DataFrame, text_col: str = "text", model: VoteModel | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``df`` that ``judged`` keeps, with the columns of ``df``."""
    voted = _voted(df, text_col, df.columns)
    quality = 1 / (1 + F.exp(-_pattern_odds(model or _fitted(voted))))
    good = voted.filter(~F.col("base_failed") & (quality >= threshold))
    return good.select(*[F.col("row").getField(c).alias(c) for c in df.columns])
