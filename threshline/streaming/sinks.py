"""A keyed sink for streams: last write wins, and a replayed batch changes nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from threshline.sources.events import GITHUB_SCHEMA, decoded


class KeyedSink:
    """Parquet below ``folder``, one subfolder a batch; a batch is overwritten as a whole when it comes again."""

    def __init__(self, folder: str, keys: tuple[str, ...], order: str):
        self.folder, self.keys, self.order = folder, keys, order

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """The last row of each key within the batch, by ``order``."""
        last = batch.groupBy(*self.keys).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in self.keys]), self.order).alias("_row"))
        last.select(*self.keys, "_row.*").write.mode("overwrite").parquet(f"{self.folder}/batch={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        """One row a key: the greatest ``order`` over all batches, so a late older event changes nothing."""
        rows = spark.read.parquet(self.folder)
        latest = F.max_by(F.struct(*[c for c in rows.columns if c not in (*self.keys, "batch")]), F.struct(self.order, "batch"))
        return rows.groupBy(*self.keys).agg(latest.alias("_row")).select(*self.keys, "_row.*")


@dataclass(frozen=True)
class HostSettings:
    """Where comments are kept; the token is never shown."""

    provider: str
    url: str = ""
    token: str = field(default="", repr=False)


class ReviewHost(Protocol):
    def overwrite(self, key: tuple, body: str) -> None:
        """Replaces the text of the comment or note that the key names."""


def posted(rows: DataFrame, keys: tuple[str, ...], body: str, host: Callable[[], ReviewHost]) -> DataFrame:
    """(keys, error): each body put over its comment; an error stays in its row, null where there was none.

    A client is made per partition.  Overwriting is idempotent, so a retried task repeats nothing that shows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = host()
        for batch in batches:
            errors: list[str | None] = []
            for key, text in zip(batch[list(keys)].itertuples(index=False, name=None), batch[body]):
                try:
                    client.overwrite(key, text)
                    errors.append(None)
                except Exception as problem:  # noqa: BLE001
                    errors.append(str(problem))
            done = batch[list(keys)].copy()
            done["error"] = pd.Series(errors, index=batch.index, dtype=object)
            yield done

    narrow = rows.select(*keys, body)
    return narrow.mapInPandas(run, T.StructType([*(narrow.schema[k] for k in keys), T.StructField("error", T.StringType())]))


def comment_stream(events: DataFrame) -> DataFrame:
    """(repo_id, comment_id, body, event_row) of a stream, or table, of raw events; events that don't decode are left out."""
    rows = decoded(events, "payload", GITHUB_SCHEMA).where("event IS NOT NULL")
    ids = (F.col(f"event.{x}.id").try_cast("bigint").alias(name) for x, name in (("repository", "repo_id"), ("comment", "comment_id")))
    return rows.select(*ids, F.col("event.comment.body").alias("body"), "event_row").where("repo_id IS NOT NULL AND comment_id IS NOT NULL")


def start(rows: DataFrame, sink: KeyedSink, checkpoint: str, step: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """The stream into the sink, until all that is there now has been read; ``step`` turns a batch into rows of the sink."""

    def write(batch: DataFrame, batch_id: int) -> None:
        sink.write(step(batch) if step else batch, batch_id)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
