"""List pages as a table function: the patterns of a site are data, joined to its pages and called laterally.

``board_rows(html, row, parts, names)`` gives a row for each match of the pattern ``row`` in a page: its ``place`` and a
column for each of ``names``, which are part of the query and so decide the schema before it runs. ``parts`` maps a name to the pattern of
that part within a row (group 1); a part without a pattern or a match is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, MapType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@lru_cache(maxsize=1000)
def _compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern, re.DOTALL)


class BoardRows:
    @staticmethod
    def analyze(html: AnalyzeArgument, row: AnalyzeArgument, parts: AnalyzeArgument, names: AnalyzeArgument) -> AnalyzeResult:
        if not names.isConstantExpression or not names.value:
            raise ValueError("the names of the columns have to be a constant text such as 'title,link'")
        if not isinstance(parts.dataType, MapType):
            raise ValueError("the patterns of the parts have to be a map from names to patterns")
        schema = StructType().add("place", IntegerType())
        for name in names.value.split(","):
            schema.add(name.strip(), StringType())
        return AnalyzeResult(schema)

    def eval(self, html: str, row: str, parts: dict, names: str) -> Iterator[tuple]:
        if html is None or row is None:
            return
        wanted = [(parts or {}).get(n.strip()) for n in names.split(",")]
        patterns = [None if p is None else _compiled(p) for p in wanted]
        for place, found in enumerate(_compiled(row).finditer(html), 1):
            parts_of = (p and p.search(found.group(0)) for p in patterns)
            yield place, *(m.group(1) if m else None for m in parts_of)


def register(spark: SparkSession) -> None:
    """Makes ``board_rows`` a function of the session's SQL."""
    spark.udtf.register("board_rows", udtf(BoardRows))


def board_rows(pages: DataFrame, sites: DataFrame, on: str, names: str, html: str = "html") -> DataFrame:
    """The rows of all pages whose site has patterns (``sites``: ``on``, ``row``, ``parts``): the columns of ``pages`` but
    the markup, ``place`` and ``names``. Pages of other sites have none."""
    spark = pages.sparkSession
    register(spark)
    kept = ", ".join(f"p.`{c}`" for c in pages.columns if c != html)
    of = "SELECT {kept}, r.* FROM {{pages}} p JOIN {{sites}} s ON p.`{on}` = s.`{on}`, LATERAL board_rows(p.`{html}`, s.row, s.parts, '{names}') r"
    return spark.sql(of.format(kept=kept, on=on, html=html, names=names), pages=pages, sites=sites)
