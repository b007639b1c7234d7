"""URL filters: host rules, and a path-template tree for the urls that no rule fits.

Per host, the segments of the paths form a tree. Level by level until the paths end, segments that
vary (few urls have one, few segments follow it, and no labels tell of it) are generalised into one
wildcard, the siblings that stay are merged where their labelled shares do not differ by more than
chance, and a template (a leaf of the generalised tree)
is rejected if its smoothed share of bad labels reaches a threshold. Labels are a column of the
caller's, or else what the host rules say of the urls that they fit; where no rule fits, a url is
labelled bad if its host's name has a word of a short list. A label decides no url: a template needs
enough of them.

The tree is built from counts of distinct (host, path shape), in which numbers, dates and hashes
are already wildcards, so the rows of a busy host shrink before anything is joined; what is left of a
host that has very many shapes is joined beside a broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.shared import joined_to_groups, unpacked, written

#: verdict, host and path of a rule; the longest that fits wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

#: The labelled sample beyond the rules: words of host names under which lists of unwanted sites file
#: gambling, adult, spam and tracking hosts (fixed values).
BAD_WORDS = ("adult", "ads", "bets", "casino", "pills", "porn", "poker", "spam", "track", "viagra")

#: A segment stays literal if so many urls have it, or so many different segments follow it.
MIN_URLS = 20
MIN_KIDS = 20
#: Siblings are merged if their bad shares differ by less than this many standard errors.
MERGE_Z = 1.96
#: Reject a template if (bad + SMOOTHING * 0.5) / (labelled + SMOOTHING) reaches REJECT.
SMOOTHING = 4.0
REJECT = 0.8
#: Rejected templates are broadcast up to this number, and joined by a shuffle beyond it.
BROADCAST_TEMPLATES = 50_000
WILD = "*"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    which, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for says, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        which, verdict = which.when(fits, rule), verdict.when(fits, says)
    return which, verdict


def shape_of(path: Column) -> Column:
    """The segments of a path, with numbers, dates and hashes as wildcards."""
    segments = F.filter(F.split(path, "/", -1), lambda s: s != "")
    return F.transform(
        segments,
        lambda s: F.when(s.rlike(r"^[0-9][0-9._-]*(\.[A-Za-z]{1,5})?$"), WILD)
        .when(s.rlike(r"^[0-9a-fA-F-]{16,}$"), WILD)
        .otherwise(s),
    )


@dataclass(frozen=True)
class Options:
    min_urls: int = MIN_URLS
    min_kids: int = MIN_KIDS
    merge_z: float = MERGE_Z
    smoothing: float = SMOOTHING
    reject: float = REJECT


def templates(counts: DataFrame, options: Options = Options()) -> DataFrame:
    """``counts`` (host, shape, n, bad, good for each distinct host and shape) with ``template``
    and ``purity`` added: the generalised path, and its smoothed share of bad labels.

    Level by level: a node's children are counted by value. One stays literal if it has
    ``min_urls`` urls or ``min_kids`` different segments below it, if it has labels and paths go on
    below it, or if it has labels enough to be rejected by itself; others become the wildcard.
    Each literal child is merged into that of its node with the most urls if both have labels and
    their bad shares are alike, or neither has labels; the wildcard is merged with none.

    A node is not divided further once its paths have ended or are one, or once it has no bad
    label, as then nothing below it can be rejected (while ``reject`` is above one half).
    """
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "good")]
    rows = F.count("*").alias("rows")
    node = ["host", "template"]
    active, level, done = counts.withColumn("template", F.lit("")), 0, []
    while True:
        size = F.size("shape")
        whole = F.max(size) <= level
        whole = whole | (F.count("*") == 1)
        if options.reject > 0.5:
            whole = whole | (F.sum("bad") == 0)
        stops = written(active.groupBy(*node).agg(whole.alias("whole"), rows), "url-stops")
        marked = written(joined_to_groups(active, stops, node, "rows").drop("rows"), "url-nodes")
        done.append(marked.filter("whole").drop("whole"))
        active = marked.filter(~F.col("whole")).drop("whole")
        if active.isEmpty():
            break
        tree = active.withColumns(
            {"value": F.coalesce(F.get("shape", F.lit(level)), F.lit("")), "next": F.get("shape", F.lit(level + 1))}
        )
        below = tree.groupBy(*node, "value", "next").agg(*sums, rows)
        values = below.groupBy(*node, "value").agg(*sums, F.sum("rows").alias("rows"), F.count("next").alias("kids"))
        labels = F.col("bad") + F.col("good")
        enough = labels + 0.5 * options.smoothing >= options.reject * (labels + options.smoothing)
        literal = (
            (F.col("n") >= options.min_urls)
            | (F.col("kids") >= options.min_kids)
            | (labels > 0) & ((F.col("kids") > 0) | enough)
        )
        values = values.withColumn("child", F.when(literal, F.col("value")).otherwise(WILD))
        values = written(values.select(*node, "value", "child", "n", "bad", "good", F.col("rows").alias("shapes")), "url-values")
        stays = F.col("child") != WILD
        most = F.max_by(F.when(stays, F.struct("child", "bad", "good")), F.when(stays, F.struct("n", "child")))
        first = written(values.groupBy(*node).agg(most.alias("first"), rows), "url-firsts")
        alike = stays & _alike(F.struct("bad", "good"), F.col("first"), options.merge_z)
        to = written(
            joined_to_groups(values, first, node, "rows").select(
                *node, "value", F.when(alike, F.col("first.child")).otherwise(F.col("child")).alias("to"), F.col("shapes").alias("rows")
            ),
            "url-children",
        )
        active = written(
            joined_to_groups(tree, to, [*node, "value"], "rows").select(
                *counts.columns, F.concat("template", F.lit("/"), "to").alias("template")
            ),
            "url-level",
        )
        level += 1
    tree = done[0]
    for more in done[1:]:
        tree = tree.unionByName(more)
    purity = written(tree.groupBy(*node).agg(F.sum("bad").alias("b"), F.sum("good").alias("g"), rows), "url-purity")
    return joined_to_groups(tree, purity, node, "rows").select(
        *counts.columns,
        "template",
        ((F.col("b") + 0.5 * options.smoothing) / (F.col("b") + F.col("g") + options.smoothing)).alias("purity"),
    )


def _alike(kid: Column, first: Column, z: float) -> Column:
    """Whether two siblings' bad shares are alike, by a test of two proportions."""
    n1, n2 = kid["bad"] + kid["good"], first["bad"] + first["good"]
    some = (n1 > 0) & (n2 > 0)
    share = (kid["bad"] + first["bad"]) / (n1 + n2)
    error = F.sqrt(share * (1 - share) * (1 / n1 + 1 / n2))
    gap = F.abs(kid["bad"] / n1 - first["bad"] / n2)
    return F.when(some, gap <= z * error).otherwise((n1 == 0) & (n2 == 0))


def judged(
    df: DataFrame,
    url_col: str = "url",
    rules=RULES,
    label: Column | None = None,
    options: Options = Options(),
    bad_words: tuple[str, ...] = BAD_WORDS,
) -> DataFrame:
    """``df`` with host, path, rule and verdict added.

    A url that no rule fits is blocked if its template is rejected, and else allowed. ``label``:
    a column that is true for bad, false for good and null for unknown; without it, the rules
    label the urls that they fit, and ``bad_words`` in the name of its host label another bad. A url that is null or has no ``://`` has an empty host and path
    and is judged as a url of the host ''. Repeated rows are judged alike; an empty table gives an
    empty result; added columns replace input columns of the same name.
    """
    url = F.col("row").getField(url_col)
    marked = df.select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *([label.alias("label")] if label is not None else [])
    )
    marked = marked.withColumns({"host": host_of(url), "path": path_of(url)})
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    marked = marked.withColumns({"rule": rule, "says": says})
    marked = marked.withColumn("shape", shape_of(F.col("path")))
    said = F.col("says") == "block"
    listed = F.when(F.col("host").rlike(rf"(?:^|[.-])(?:{'|'.join(bad_words)})(?=[.-])"), F.lit(True)) if bad_words else F.lit(None)
    bad = F.col("label") if label is not None else F.coalesce(said, listed)
    counts = written(
        marked.select("host", "shape", bad.alias("isbad"))
        .groupBy("host", "shape")
        .agg(F.count("*").alias("n"), F.count_if("isbad").alias("bad"), F.count_if(~F.col("isbad")).alias("good")),
        "url-shapes",
    )
    rejected = written(
        templates(counts, options).filter(F.col("purity") >= options.reject).select("host", "shape"),
        "url-rejects",
    ).withColumn("reject", F.lit(True))
    if rejected.limit(BROADCAST_TEMPLATES + 1).count() <= BROADCAST_TEMPLATES:
        out = marked.join(F.broadcast(rejected), ["host", "shape"], "left")
    else:
        # urls of a busy host go to many tasks; its templates go with each part of them
        parts = 16
        salted = rejected.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        out = marked.withColumn("salt", F.pmod(F.xxhash64(url), F.lit(parts)).cast("int")).join(
            salted, ["host", "shape", "salt"], "left"
        )
    verdict = F.coalesce(F.col("says"), F.when(F.col("reject"), "block"), F.lit("allow"))
    return unpacked(out.withColumn("verdict", verdict), df.columns, ["host", "path", "rule", "verdict"])
