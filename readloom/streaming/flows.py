"""Structured Streaming forms: filter, counts, pairing, routing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from readloom.operators.reads import count_by_group, filter_reads
from readloom.session import ship


def stream_filter(stream: DataFrame, *flags: str, min_quality: int = 0) -> DataFrame:
    """Stateless: the same plan as in batch; append mode."""
    return filter_reads(stream, *flags, min_quality=min_quality)


def stream_counts(stream: DataFrame, read_group: str = "rg") -> DataFrame:
    """Running counts of each read group; complete or update mode."""
    return count_by_group(stream, read_group)


class _Pairing(StatefulProcessor):
    """Holds at most one pending read of each name."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getValueState("pending", "ord bigint, flag int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.pending.get()) if self.pending.exists() else None
        out = []
        frame = pd.concat(list(rows)).sort_values("ord", kind="stable")
        for o, f in zip(frame["ord"].tolist(), frame["flag"].tolist()):
            if held is None:
                held = (o, f)
            else:
                out.append((key[0], held[0], o, held[1], f))
                held = None
        if held is None:
            self.pending.clear()
        else:
            self.pending.update(held)
        yield pd.DataFrame(out, columns=["qname", "first_ord", "second_ord", "first_flag", "second_flag"])

    def close(self) -> None:
        pass


def stream_pairs(stream: DataFrame) -> DataFrame:
    """Pairs of reads by name as they close; needs the RocksDB state store.

    Rows have qname, ord and flag. Reads without a mate stay pending; a stream
    has no end at which to emit them, so batch mode is for single reads.
    """
    ship(stream.sparkSession)
    return stream.select("qname", "ord", "flag").groupBy("qname").transformWithStateInPandas(
        _Pairing(), "qname string, first_ord bigint, second_ord bigint, first_flag int, second_flag int", "Append", "none"
    )


def stream_split(stream: DataFrame, folder: str, checkpoint: str, read_group: str = "rg"):
    """Starts a query that writes each batch to a folder for each read group; a read without one raises, as in batch mode."""
    label = F.coalesce(F.col(read_group), F.raise_error(F.lit("auxiliary field 'RG' not found")).cast("string"))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("split_rg", label).write.mode("overwrite").partitionBy("split_rg").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
