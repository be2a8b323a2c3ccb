"""The directory of a store as events: clusters come and go, and their extents grow, are cut or are dropped.

The state of a cluster depends on its own events in order and on nothing else, so clusters are folded apart from one another.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

EVENTS = ("create", "append", "truncate", "delete")


def replayed(events: DataFrame) -> DataFrame:
    """The current extents from (segment, cluster, seq, event, physical_start, length): a row for each extent, or one with the fault.

    create begins a cluster, append adds an extent at its end, truncate keeps `length` bytes, delete ends it.
    """

    def fold(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        extents: list[list[int]] | None = None
        fault = ""
        for e in group.sort_values("seq").itertuples(index=False):
            if e.event == "create" and extents is None:
                extents = []
            elif extents is None or e.event not in EVENTS or e.event == "create":
                fault = f"MALFORMED_SOURCE: {e.event} at {e.seq}"
                break
            elif e.event == "append":
                if extents and sum(extents[-1]) == e.physical_start:
                    extents[-1][1] += int(e.length)
                else:
                    extents.append([int(e.physical_start), int(e.length)])
            elif e.event == "truncate":
                left, kept = int(e.length), []
                for start, size in extents:
                    if left > 0:
                        kept.append([start, min(size, left)])
                        left -= size
                extents = kept
            else:
                extents = None
        if fault:
            return pd.DataFrame([(*key, None, None, None, fault)], columns=NAMES)
        rows, at = [], 0
        for start, size in extents or []:
            rows.append((*key, at, start, size, "CURRENT"))
            at += size
        return pd.DataFrame(rows, columns=NAMES)

    return events.groupBy("segment", "cluster").applyInPandas(fold, "segment long, cluster long, logical_start long, physical_start long, length long, status string")


NAMES = ["segment", "cluster", "logical_start", "physical_start", "length", "status"]
