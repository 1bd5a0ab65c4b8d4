"""Change feeds over streams: the handlers' and observed dictionaries' work on unbounded input."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _changed(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    old = state.get[0] if state.exists else None
    first, out = not state.exists, []
    for r in pd.concat(list(parts)).sort_values("at").itertuples():
        value = None if pd.isna(r.value) else r.value
        if first or value != old:
            out.append((*key, value, old, r.at))
        old, first = value, False
    state.update((old,))
    yield pd.DataFrame(out, columns=["owner", "key", "new", "old", "at"])


def observed_stream(settings: DataFrame) -> DataFrame:
    """Of settings (owner, key, value string, at long): those that change their key's value; state is one value a key."""
    return settings.groupBy("owner", "key").applyInPandasWithState(_changed, "owner string, key string, new string, old string, at long", "value string", "append", GroupStateTimeout.NoTimeout)


def windowed_changes(events: DataFrame, time: str, key: str, width: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts of events by key and window; rows later than ``late`` are left out once a window is closed."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(window, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def watch(stream: DataFrame, handlers: list[Callable[[Any, DataFrame], Any]], graph: Any = None, checkpoint: str | None = None) -> Any:
    """Call handlers with each batch in turn; one that returns False stops those after it."""

    def batch(delta: DataFrame, _: int) -> None:
        for handler in handlers:
            if handler(graph, delta) is False:
                break

    writer = stream.writeStream.foreachBatch(batch)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).trigger(availableNow=True).start()
