"""Readers of heterogeneous inputs into tables of fixed schemas."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def positional_csv(spark: SparkSession, path: str, columns: Sequence[str], required: str) -> DataFrame:
    """A CSV file without use of its header: fields by place, quotes and embedded lines respected, a
    byte-order mark dropped; rows without the required field go."""
    schema = StructType()
    for c in columns:
        schema.add(c, "string")
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("multiLine", True).option("escape", '"').csv(path)
    clean = [F.nullif(F.trim(F.replace(F.col(c), F.lit("﻿"), F.lit(""))), F.lit("")).alias(c) for c in columns]
    return rows.select(*clean).filter(F.col(required).isNotNull())


def json_rows(spark: SparkSession, path: str, array: str, schema: str, whole: str = "") -> DataFrame:
    """The rows of an array in JSON files, one file a document; the fields in ``whole`` (a schema), such
    as a version, are those of the file and stand beside each of its rows."""
    fields = f"{array} array<struct<{schema}>>" + (f", {whole}" if whole else "")
    files = spark.read.schema(fields).option("multiLine", True).json(path)
    beside = [c for c in files.columns if c != array]
    return files.select(*beside, F.explode(array).alias("r")).select("r.*", *beside)


def xml_items(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """The repeated elements of XML files; a missing element is an empty text."""
    rows = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])


def html_rows(pages: DataFrame, config: Mapping[str, str], html: str = "html", keep: Sequence[str] = ("url",)) -> DataFrame:
    """Rows of list pages by patterns: ``row`` finds rows, ``title``, ``link`` and ``date`` their
    parts (group 1). Two dates or more are from and to; one is the posting's or, where ``single`` is
    ``deadline``, the end of the period; titles of fewer than four characters go. Rows that match
    ``skip``, if there is one, go too."""
    rows = pages.select(*keep, F.explode(F.regexp_extract_all(html, F.lit(config["row"]), F.lit(0))).alias("row"))
    if "skip" in config:
        rows = rows.filter(~F.col("row").rlike(config["skip"]))
    found = F.regexp_extract_all("row", F.lit(config["date"]), F.lit(1))
    rows = rows.select(
        *keep,
        F.trim(F.regexp_extract("row", config["title"], 1)).alias("title"),
        F.regexp_extract("row", config["link"], 1).alias("link"),
        found.alias("dates"),
    ).filter(F.length("title") >= 4)
    many, one = F.size("dates") >= 2, F.size("dates") == 1
    is_end = F.lit(config.get("single") == "deadline")
    first = F.get("dates", F.lit(0))
    return rows.select(
        *keep,
        "title",
        "link",
        F.when(many, first).alias("from_date"),
        F.when(many, F.element_at("dates", -1)).when(one & is_end, first).alias("to_date"),
        F.when(one & ~is_end, first).alias("posted"),
    )


def union_sources(sources: Mapping[str, DataFrame], name: str = "source") -> DataFrame:
    """Tables of differing columns as one, with the name of each row's source."""
    named = [df.withColumn(name, F.lit(s)) for s, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def json_board(bodies: DataFrame, config: Mapping[str, str], body: str = "body", keep: Sequence[str] = ("site",)) -> DataFrame:
    """Rows of boards that answer in JSON: ``rows`` is the dotted path to their array, ``title``,
    ``from_date``, ``to_date`` name their fields, ``link`` is a template with ``{field}`` and ``total`` the path
    to the declared total. A body that is no JSON, or has no array there, has no rows."""
    names = dict.fromkeys([config["title"], config.get("from_date", ""), config.get("to_date", ""), *re.findall(r"\{(\w+)\}", config["link"])])
    schema = "array<struct<" + ",".join(f"`{n}`:string" for n in names if n) + ">>"
    array = F.from_json(F.get_json_object(body, f"$.{config['rows']}"), schema)
    total = F.get_json_object(body, f"$.{config['total']}").try_cast("long") if "total" in config else F.lit(None).cast("long")
    rows = bodies.select(*keep, total.alias("total"), F.explode(array).alias("r"))
    parts = re.split(r"\{(\w+)\}", config["link"])
    link = F.concat(*[F.lit(p) if i % 2 == 0 else F.coalesce(F.col("r")[p], F.lit("")) for i, p in enumerate(parts)])
    field = lambda c: (F.col("r")[config[c]] if c in config else F.lit(None).cast("string")).alias(c)
    return rows.select(*keep, field("title"), link.alias("link"), field("from_date"), field("to_date"), "total")


def by_type(pages: DataFrame, kinds: Mapping[str, Callable[[DataFrame], DataFrame]], kind: str = "kind") -> DataFrame:
    """Each page read by the reader of its type, as one table; pages of unknown types have no rows."""
    read = [reader(pages.filter(F.col(kind) == name)).withColumn(kind, F.lit(name)) for name, reader in kinds.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), read)


def sheet_rows(sheets: DataFrame, columns: Mapping[str, str], body: str = "body", keep: Sequence[str] = ()) -> DataFrame:
    """Rows of sheets that come wrapped in a call, ``f({"cols": [{"label": ..}], "rows": [{"c": [{"v": ..}]}]})``:
    columns are found by their labels, whatever their places; a label that is missing gives nulls."""
    schema = "struct<cols:array<struct<label:string>>,rows:array<struct<c:array<struct<v:string>>>>>"
    inside = F.regexp_extract(body, r"(?s)^[^(]*\((.*)\)\s*;?\s*$", 1)
    rows = sheets.select(*keep, F.from_json(inside, schema).alias("t")).select(*keep, "t.cols", F.explode("t.rows").alias("r"))
    place = lambda label: F.array_position(F.transform("cols", lambda c: c["label"]), label).cast("int")
    value = lambda label: F.when(place(label) > 0, F.get(F.col("r.c"), place(label) - 1)["v"])
    return rows.select(*keep, *[F.nullif(F.trim(value(label)), F.lit("")).alias(name) for name, label in columns.items()])


def supplemented(main: DataFrame, extras: Mapping[str, DataFrame], key: str) -> DataFrame:
    """A main list with the rows that extra slices add: each key once (the main list's row if it has one,
    else that of the first slice by name), with the names of all the lists that have it."""
    rows = union_sources({"": main, **extras}, "_list")
    columns = [c for c in rows.columns if c not in (key, "_list")]
    order = F.struct((F.col("_list") != "").alias("extra"), F.col("_list").alias("name"))
    out = rows.groupBy(key).agg(F.min_by(F.struct(*columns), order).alias("_row"), F.array_sort(F.collect_set("_list")).alias("_lists"))
    return out.select(key, "_row.*", F.filter("_lists", lambda x: x != "").alias("tags"), F.array_contains("_lists", "").alias("in_main"))
