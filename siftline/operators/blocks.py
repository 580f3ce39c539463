"""Vectors in files of bounded size in the shared folder, which tasks read one after the other.

Where each row has to meet most blocks of the others, a shuffle writes one copy of it per block. Here the
rows lie in the folder once, and disk grows with the rows, not with their square.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from siftline.session import scratch

# Helpers travel with the task, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def write_blocks(df: DataFrame, order: Sequence[str], n: int, rows: int, name: str) -> list[str]:
    """Write the ``n`` rows of ``df`` in this order to files of about ``rows`` rows; their URIs in order."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.repartitionByRange(max(1, -(-n // rows)), *order).sortWithinPartitions(*order).write.parquet(path)
    return sorted(spark.read.schema(df.schema).parquet(path).inputFiles())


def read_blocks(uri: str, rows: int, between: tuple[str, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """The rows of a file, at most ``rows`` at a time; none if no value of ``between`` is within its column's range."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri("file://" + uri[len("file:"):] if uri.startswith("file:/") and not uri.startswith("file://") else uri)
    with system.open_input_file(path) as source:
        file = pq.ParquetFile(source)
        if between is not None:
            column, values = between
            groups = [file.metadata.row_group(i).column(file.schema_arrow.get_field_index(column)).statistics for i in range(file.metadata.num_row_groups)]
            if all(s is not None and s.has_min_max and not ((values >= s.min) & (values <= s.max)).any() for s in groups):
                return
        yield from (b for b in file.iter_batches(batch_size=rows) if b.num_rows)


def matrix(lists: pa.Array, n: int) -> np.ndarray:
    """Lists of equal length as rows; a missing number is NaN."""
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, -1)
