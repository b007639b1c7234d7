"""States of attempts to read lists, and what roles may see."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import error_signature

#: Rows beyond which a count is not believed, and rows of a preview.
MOST_ROWS, PREVIEW_ROWS = 100_000, 20


def list_state(status: Column, network_error: Column, has_page: Column, title: Column, text: Column, has_password: Column, rows: Column) -> Column:
    """State, reason and believed row count of an attempt to read a list. Zero rows are not yet an empty
    list, and a page that shows an error is only suspected of it."""
    valid = status.between(100, 599)
    good_rows = rows.between(0, MOST_ROWS)
    failed = F.coalesce(network_error, F.lit(False))
    signature = error_signature(title, text, has_password)
    order = (
        (failed & status.isNotNull(), "undetermined", "contradiction"),
        (failed, "network", None),
        (status.isNull(), "undetermined", "no status"),
        (~valid, "undetermined", "bad status"),
        (status != 200, "status", None),
        (~F.coalesce(has_page, F.lit(False)), "undetermined", "no page"),
        (signature.isNotNull(), "page of an error", "signature"),
        (rows.isNull(), "undetermined", "no row count"),
        (~good_rows, "undetermined", "bad row count"),
        (rows == 0, "no rows", "cause unknown"),
    )
    state, reason = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for holds, name, why in order:
        state, reason = state.when(holds, name), reason.when(holds, F.lit(why).cast("string"))
    count = F.when(~failed & (status == 200) & good_rows, rows)
    return F.struct(state.otherwise("rows").alias("state"), reason.alias("reason"), count.alias("n_rows"))


def seen_by(df: DataFrame, role: str, order: str, names: Sequence[str], secrets: Sequence[str]) -> DataFrame:
    """``df`` as a role sees it: members see all, guests names by their beginning and no secrets, and a
    preview has the first rows of what guests see."""
    if role == "member":
        return df
    masked = df.withColumns({c: F.concat(F.substring(c, 1, 3), F.lit("***")) for c in names})
    masked = masked.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in secrets})
    return masked.orderBy(order).limit(PREVIEW_ROWS) if role == "preview" else masked


#: Texts that say that a page is gone or a posting over (fixed values).
GONE_TEXT = r"삭제된\s*(?:글|게시물)|존재하지\s*않는|페이지를\s*찾을\s*수\s*없습니다|(?i)\bnot found\b"
CLOSED_ALERT = r"alert\(\s*['\"][^'\"]*(?:마감|종료)[^'\"]*['\"]"
CLOSED_PERIOD = r"(?:접수|모집|원서)\s*기간[^가-힣0-9]{0,8}(?:＜|<|\[|\()?\s*마감"
#: Characters of text below which a page says nothing.
LEAST_TEXT = 200


def liveness(status: Column, html: Column, text: Column, title: Column, landed: Column, asked: Column) -> Column:
    """Whether a posting's page is alive, gone, closed or unknown, and why, by tests in their order. A
    closed mark before the posting's own title counts; a page under another address counts as gone
    only if the title isn't on it."""
    core = F.regexp_replace(F.coalesce(title, F.lit("")), r"^\s*(?:\[[^\]]*\]|\([^)]*\))\s*", "")
    squeezed = lambda c: F.regexp_replace(c, r"\s+", "")
    has_title = (core != "") & F.contains(squeezed(text), squeezed(core))
    marked = F.exists(F.array(*[F.lit(m) for m in ("[마감]", "(마감)", "[채용완료]")]), lambda m: F.contains(squeezed(text), F.concat(m, squeezed(core)))) & (core != "")
    path = lambda u: F.regexp_extract(u, r"^[a-z]+://[^/]*([^?#]*)", 1)
    order = (
        (status.isNull(), "unknown", "no answer"),
        (status.isin(404, 410), "gone", "status"),
        (status >= 400, "unknown", "status"),
        (text.rlike(GONE_TEXT), "gone", "text"),
        (html.rlike(CLOSED_ALERT), "closed", "alert"),
        (F.length(text) < LEAST_TEXT, "unknown", "little text"),
        (marked, "closed", "title"),
        (text.rlike(CLOSED_PERIOD), "closed", "period"),
        (~has_title & (path(landed) != path(asked)), "gone", "elsewhere"),
    )
    state, why = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for holds, name, reason in order:
        holds = F.coalesce(holds, F.lit(False))
        state, why = state.when(holds, name), why.when(holds, reason)
    return F.struct(state.otherwise("alive").alias("state"), why.otherwise(F.when(has_title, "title").otherwise("opens")).alias("why"))
