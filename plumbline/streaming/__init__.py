"""The phases over a stream of records: each micro-batch is run as a batch, so responses are those of its own records. Measures are sums over the written responses."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from plumbline.model import PHASES, Binding
from plumbline.operators import execute


def run_stream(records: DataFrame, bindings: Sequence[Binding], path: str, checkpoint: str, dedup: bool = True, **trigger) -> StreamingQuery:
    """Writes the responses of each micro-batch to path/batch=N, which a repeated batch overwrites: exactly once."""
    direct = [b for b in bindings if b.measure is None]

    def each(batch: DataFrame, n: int) -> None:
        out = execute.run_phases(batch, direct, dedup)
        reduce(DataFrame.unionByName, [out[p] for p in PHASES]).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
