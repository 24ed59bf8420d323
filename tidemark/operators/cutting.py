"""Cutting each tenant's records into blocks, greedily by encoded size in order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import functions as X
from tidemark.schema import Limits


def cut(records: DataFrame, flush_bytes: int = Limits.flush_bytes, order: str = "seq", part: str | None = None) -> DataFrame:
    """records with block_no and ordinal, from 0, per tenant (and part).

    Before a record is added, a block that holds something and would exceed flush_bytes is closed; a record larger
    than that stands alone. The cut depends on all that came before, so a tenant's records pass through one task, in
    order, as a stream of batches with nothing kept but two counters. `part` names a column (an ingest batch, say)
    by which a large tenant's records are cut independently and in parallel.
    """
    keys = ["tenant_id", *([part] if part else [])]
    sized = records.withColumn("tm_size", X.encoded_size(F.col("message"), F.col("tags")))
    fields = [*records.schema.fields]
    names = records.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, ordinal, held = None, 0, 0, 0
        for batch in batches:
            blocks, ordinals = [], []
            at = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            for key, size in zip(zip(*at, strict=True), pc.cast(batch.column(batch.num_columns - 1), pa.int64()).to_pylist(), strict=True):
                if key != now:
                    now, block, ordinal, held = key, 0, 0, 0
                elif held and held + size > flush_bytes:
                    block, ordinal, held = block + 1, 0, 0
                blocks.append(block)
                ordinals.append(ordinal)
                ordinal, held = ordinal + 1, held + size
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(blocks, pa.int64()), pa.array(ordinals, pa.int32())], names=[*names, "block_no", "ordinal"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "block_no long", "ordinal int"])
    return sized.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)
