"""Query name -> builder, and query name -> oracle SQL."""

from millrace.plans import boards, calendar, classification, inputs, keeping, listing, merging, observing, paging, pay, selections, statistics, streams, texts, triage, wording  # noqa: F401
from millrace.plans.registry import ORACLES, QUERIES  # noqa: F401

FLAGSHIP = "competition_ratio"
