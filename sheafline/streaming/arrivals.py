"""An extension beyond the batch dataflow: documents that arrive one by one, judged when their bundle is complete.

State is kept by bundle: the types seen so far. A bundle is given out once, when all types are there or, by a timer, when
none has come for a while; what is missing then fails completeness as in a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..model import DOC_TYPES

OUT = "bundle_id string, present array<string>, complete boolean"


def assemble(docs: DataFrame, wait_ms: int = 3_600_000) -> DataFrame:
    """bundle_id, present and complete, from a stream of (bundle_id, doc_type)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0].split(",")) - {""} if state.exists else set()
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"bundle_id": [key[0]], "present": [sorted(seen)], "complete": [False]})
            return
        for batch in batches:
            seen |= set(batch["doc_type"].dropna()) & set(DOC_TYPES)
        if seen == set(DOC_TYPES):
            if state.exists:
                state.remove()
            yield pd.DataFrame({"bundle_id": [key[0]], "present": [sorted(seen)], "complete": [True]})
        else:
            state.update((",".join(sorted(seen)),))
            state.setTimeoutDuration(wait_ms)

    return docs.groupBy("bundle_id").applyInPandasWithState(step, OUT, "seen string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events and their value by window and type, with a bound on lateness."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")
