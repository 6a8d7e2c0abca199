"""The last exchanges of each chat, as keyed state of a stream; scalars from a stream, each batch once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text as T

if TYPE_CHECKING:
    import pandas as pd

OUT = "id long, ord long, history string"


def rolling(turns: DataFrame, frame: int = 20, expire_ms: int = 86_400_000, late: str = "1 hour") -> DataFrame:
    """id, ord, history of a stream of turns (id, ord, ts, text): the last `frame` cleaned utterances up to each turn, without empty ones.

    A chat's state is its last utterances, which go when the watermark (`late` behind the latest turn of all) is `expire_ms` past
    its last turn. Turns of a chat that come in one batch are taken in order of ord; those of
    a later batch are later."""

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(chunks)).sort_values("ord", kind="stable")
        last, out = list(state.get[0]) if state.exists else [], []
        for t in rows["text"]:
            last = [*last, t][-frame:]
            out.append(T.EOT.join(x for x in last if x))
        state.update((last,))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(rows["ts"].max().timestamp() * 1000)) + expire_ms)
        yield pd.DataFrame({"id": key[0], "ord": rows["ord"].to_numpy(), "history": out})

    clean = turns.withWatermark("ts", late).select(F.col("id").cast("long").alias("id"), F.col("ord").cast("long").alias("ord"), "ts", T.clean(F.col("text")).alias("text"))
    return clean.groupBy("id").applyInPandasWithState(step, OUT, "last array<string>", "append", GroupStateTimeout.EventTimeTimeout)


def append_batch(rows: DataFrame, batch: int, path: str) -> None:
    """tag, step, value rows of one batch of a stream, for foreachBatch: a batch that comes again replaces its own rows, so nothing is added twice."""
    rows.select("tag", "step", "value").write.mode("overwrite").parquet(f"{path}/batch={batch}")


def scalars(rows: DataFrame, path: str, checkpoint: str):
    """The running query that appends a stream's scalars."""
    return rows.writeStream.foreachBatch(lambda df, n: append_batch(df, n, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
