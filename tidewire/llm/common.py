"""What the operators share: written intermediate tables, bounded chunks of Arrow batches, the training split."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.session import store  # noqa: F401  the operators import it from here

#: Bytes of text that one vectorised step takes at once; its arrays need some forty times as much.
CHUNK_BYTES = 2 << 20


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id's text modulo ``n``; null ids count as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have at most ``limit`` bytes together, or one row that has more."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > limit:
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += int(n)
    if first < len(lengths):
        yield batch.slice(first)
