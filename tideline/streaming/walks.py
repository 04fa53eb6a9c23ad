"""Completeness of walks while their pages land, in any order, with a timer that closes them.

State per (source, walk) is one entry a page number, none beyond the cap, so it is bounded whatever lands. Each batch gives the
outcome of the walks whose pages it held, as it is so far; the last one given is the outcome. When no page of a walk has
landed for a time, by the watermark on ``landed_at``, its outcome is given once more, closed, and its state goes; pages that
come behind the watermark are dropped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RESULT = "source STRING, walk BIGINT, n_pages BIGINT, n_items BIGINT, failed BOOLEAN, exhausted BOOLEAN, closed BOOLEAN"


def outcome(pages: dict[int, list], page_size: int, most_pages: int) -> tuple[int, int, bool, bool]:
    """(pages, items, failed, exhausted) from page -> [rows, items, a row failed, a row was short]."""
    bad = min((p for p, x in pages.items() if x[2]), default=None)
    short = min((p for p, x in pages.items() if x[3]), default=None)
    stop = min(most_pages if bad is None else bad - 1, most_pages if short is None else short)
    counted = [x for p, x in pages.items() if p <= stop]
    return sum(x[0] for x in counted), sum(x[1] for x in counted), bad == 1, short is not None and short < (most_pages + 1 if bad is None else bad)


def outcomes(pages: DataFrame, page_size: int, most_pages: int, timeout: str = "1 day") -> DataFrame:
    """Outcomes of a stream of (source, walk, page, n_items, ok, landed_at), in update mode, with ``closed``."""
    wait_ms = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            seen, latest = json.loads(state.get[0]), state.get[1]
            state.remove()
        else:
            seen, latest = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, 0)
            for part in parts:
                landed = part["landed_at"].max()
                latest = max(latest, 0 if pd.isna(landed) else int(landed.timestamp() * 1000))
                within = part[part["page"] <= most_pages]
                for page, n, ok in zip(within["page"], within["n_items"], within["ok"], strict=True):
                    x = seen.setdefault(str(int(page)), [0, 0, False, False])
                    known = not pd.isna(ok)  # what is not known is neither failed nor short
                    short = known and bool(ok) and not pd.isna(n) and n < page_size
                    seen[str(int(page))] = [x[0] + 1, x[1] + (0 if pd.isna(n) else int(n)), x[2] or known and not ok, x[3] or short]
            state.update((json.dumps(seen), latest))
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + wait_ms)
        n_pages, n_items, failed, exhausted = outcome({int(p): x for p, x in seen.items()}, page_size, most_pages)
        yield pd.DataFrame({"source": [key[0]], "walk": [key[1]], "n_pages": [n_pages], "n_items": [n_items], "failed": [failed], "exhausted": [exhausted], "closed": [not state.exists]})

    marked = pages.withWatermark("landed_at", timeout)
    return marked.groupBy("source", "walk").applyInPandasWithState(step, RESULT, "pages STRING, latest BIGINT", "update", GroupStateTimeout.EventTimeTimeout)


def last_given(batches: DataFrame) -> DataFrame:
    """Of each walk the outcome given last; ``batches`` have their number as ``batch``."""
    names = [c.split()[0] for c in RESULT.split(", ")][2:]
    last = F.max_by(F.struct(*names), F.struct("batch", "closed")).alias("last")
    return batches.groupBy("source", "walk").agg(last).select("source", "walk", "last.*")
