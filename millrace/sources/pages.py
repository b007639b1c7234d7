"""What list pages say of themselves: totals, paging, and what robots.txt allows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of query parameters that may number pages (fixed values).
PAGE_PARAMETERS = ("page", "pageno", "pageindex", "pagenum", "pg", "p", "currentpage", "cpage", "offset", "start")


def declared_total(html: Column) -> Column:
    """The number of entries that a list page declares."""
    digits = F.regexp_extract(html, r"(?:전체|총|[Tt]otal)\s*:?\s*(?:<[^>]*>\s*)*([0-9][0-9,]*)", 1)
    return F.replace(digits, F.lit(","), F.lit("")).try_cast("long")


def paging_links(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("url",)) -> DataFrame:
    """Links of a page whose query has a paging parameter with a number: name and number."""
    links = F.explode(F.regexp_extract_all(html, F.lit(r'href="([^"]*\?[^"]*)"'), F.lit(1))).alias("link")
    out = pages.select(*keep, links)
    pair = F.explode(F.regexp_extract_all("link", F.lit(r"[?&;]([A-Za-z_]+=[0-9]+)"), F.lit(1))).alias("pair")
    out = out.select(*keep, "link", pair)
    name = F.lower(F.substring_index("pair", "=", 1))
    return out.select(*keep, "link", name.alias("name"), F.substring_index("pair", "=", -1).cast("long").alias("number")).filter(
        F.col("name").isin(*PAGE_PARAMETERS)
    )


def paging_parameter(pages: DataFrame, html: str = "html", keep: Sequence[str] = ("url",)) -> DataFrame:
    """The parameter that pages a list: the paging name with the most different numbers, two at
    least."""
    counts = paging_links(pages, html, keep).groupBy(*keep, "name").agg(F.count_distinct("number").alias("n_pages"))
    best = F.max_by(F.struct("name", "n_pages"), F.struct("n_pages", "name")).alias("best")
    return counts.filter("n_pages >= 2").groupBy(*keep).agg(best).select(*keep, "best.*")


def robots_rules(text: Column, agent: str = "*") -> Column:
    """The rules (allow, path) of the groups of a robots.txt that name ``agent``."""
    none = F.array().cast("array<struct<allow:boolean,path:string>>")
    start = F.struct(F.lit(False).alias("ours"), F.lit(False).alias("named"), none.alias("rules"))
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))

    def step(s, line):
        key = F.lower(F.trim(F.substring_index(line, ":", 1)))
        value = F.trim(F.regexp_replace(line, "^[^:]*:", ""))
        is_agent, is_rule = key == "user-agent", key.isin("allow", "disallow") & (value != "")
        # agents that follow each other share what comes after them
        ours = F.when(is_agent, (F.lower(value) == agent.lower()) | (s["ours"] & s["named"])).otherwise(s["ours"])
        one = F.array(F.struct((key == "allow").alias("allow"), value.alias("path")))
        named = F.when(is_agent, True).when(line == "", s["named"]).otherwise(False)
        rules = F.when(is_rule & s["ours"], F.concat(s["rules"], one)).otherwise(s["rules"])
        return F.struct(ours.alias("ours"), named.alias("named"), rules.alias("rules"))

    return F.aggregate(lines, start, step)["rules"]


def robots_allow(rules: Column, path: Column) -> Column:
    """Whether the longest rule that begins the path allows it; equal lengths allow."""
    fit = F.filter(rules, lambda r: path.startswith(r["path"]))
    best = F.array_max(F.transform(fit, lambda r: F.struct(F.length(r["path"]).alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def crawl_delay(text: Column, agent: str = "*") -> Column:
    """The seconds between requests that the groups of a robots.txt for ``agent`` ask for; null for none."""
    start = F.struct(F.lit(False).alias("ours"), F.lit(False).alias("named"), F.lit(None).cast("double").alias("delay"))
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), lambda x: F.trim(F.regexp_replace(x, "#.*$", "")))

    def step(s, line):
        key = F.lower(F.trim(F.substring_index(line, ":", 1)))
        value = F.trim(F.regexp_replace(line, "^[^:]*:", ""))
        is_agent = key == "user-agent"
        ours = F.when(is_agent, (F.lower(value) == agent.lower()) | (s["ours"] & s["named"])).otherwise(s["ours"])
        named = F.when(is_agent, True).when(line == "", s["named"]).otherwise(False)
        delay = F.when((key == "crawl-delay") & s["ours"] & s["delay"].isNull(), value.try_cast("double")).otherwise(s["delay"])
        return F.struct(ours.alias("ours"), named.alias("named"), delay.alias("delay"))

    return F.aggregate(lines, start, step)["delay"]


def pages_differ(pages: DataFrame, site: str, number: str, rows: Column) -> DataFrame:
    """Whether a site's second page has other rows than its first: paging that answers with the same
    page again is none. ``rows``: an array of what tells rows apart."""
    sums = pages.select(site, number, F.xxhash64(F.array_sort(rows)).alias("_sum"), F.size(rows).alias("_n"))
    first, second = (F.max_by(F.when(F.col(number) == i, F.col("_sum")), F.when(F.col(number) == i, F.lit(1))) for i in (1, 2))
    some = F.max(F.when(F.col(number) == 2, F.col("_n")))
    return sums.groupBy(site).agg((F.coalesce(first != second, F.lit(False)) & F.coalesce(some > 0, F.lit(False))).alias("pages"))
