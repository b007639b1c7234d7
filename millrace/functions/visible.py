"""What a reader sees of a page: a scan with state, so a function over Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

#: Elements without an end, elements whose content is no text to read, and elements whose text is a link
#: or a drawing (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style template noscript textarea xmp iframe noembed noframes a svg".split())


def _hidden(attributes: dict[str, str | None]) -> bool:
    """Whether an element is hidden by an attribute (whatever its value) or its own style."""
    if "hidden" in attributes:
        return True
    for declaration in (attributes.get("style") or "").split(";"):
        name, _, value = declaration.partition(":")
        value = value.lower().replace("!important", "").strip()
        if (name.strip().lower(), value) in (("display", "none"), ("visibility", "hidden"), ("visibility", "collapse")):
            return True
    return False


class _Reader(HTMLParser):
    """Text outside hidden elements, links and scripts; the title; whether there is a password field."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] | None = None
        self.in_title = self.has_password = False
        self.skip: tuple[str, int] | None = None  # the hidden element that is open, and how often its tag is

    def handle_starttag(self, tag, attrs):
        own = dict(attrs)
        if self.skip:
            if tag == self.skip[0] and tag not in VOID:
                self.skip = (tag, self.skip[1] + 1)
            return
        if tag == "input" and (own.get("type") or "").strip().lower() == "password" and not _hidden(own):
            self.has_password = True
        if tag == "title" and self.title is None:
            self.title, self.in_title = [], True
        elif tag not in VOID and (tag in UNREAD or _hidden(own)):
            self.skip = (tag, 1)
        else:
            self.parts.append(" ")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash at the end closes nothing in HTML

    def handle_endtag(self, tag):
        self.in_title = self.in_title and tag != "title"
        if self.skip and tag == self.skip[0]:
            self.skip = (tag, self.skip[1] - 1) if self.skip[1] > 1 else None
        elif not self.skip:
            self.parts.append(" ")

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        elif not self.skip:
            self.parts.append(data)


def visible(page: str) -> tuple[str, str | None, bool, bool]:
    """(text, title, has a password field, is cut off) of a page."""
    reader = _Reader()
    reader.feed(page)
    cut_off = reader.rawdata.lstrip().startswith("<") or reader.in_title  # a tag or comment without its end
    tidy = lambda parts: " ".join("".join(parts).split())
    return tidy(reader.parts), None if reader.title is None else tidy(reader.title), reader.has_password, cut_off


SEEN = StructType([StructField("text", StringType()), StructField("title", StringType()), StructField("has_password", BooleanType()), StructField("cut_off", BooleanType())])


@pandas_udf(SEEN)
def visible_text(pages: pd.Series) -> pd.DataFrame:
    """What a reader sees of each page; nulls for null."""
    none = (None, None, None, None)
    return pd.DataFrame([none if p is None else visible(p) for p in pages], columns=SEEN.names)
