"""Pixels dealt by image into pieces of a bounded number, so that most images are whole in one task and none needs to be.

Rows are dealt by ranges of the image and its channels, so an image of any size spreads over tasks. A task
meets each image's rows one after the other. An image that begins and ends inside a task, with at most
PIECE rows, is whole there; those at a task's ends, and larger ones, come as pieces.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECE = 4096
#: Rows of a task.
TASK_ROWS = 1 << 16
CHANNELS = ("r", "g", "b", "r2", "g2", "b2")


def dealt(pixels: DataFrame) -> DataFrame:
    """image and the channels as doubles, in ranges of TASK_ROWS rows or so, each sorted. The work of a row is far more than its bytes tell, so the number of tasks is stated."""
    rows = pixels.select("image", *[F.col(c).cast("double").alias(c) for c in CHANNELS])
    order = ["image", *CHANNELS]
    return rows.repartitionByRange(-(-pixels.count() // TASK_ROWS) or 1, *order).sortWithinPartitions(*order)


def _ends(names: pa.Array) -> np.ndarray:
    """Where runs of equal names end."""
    a, b = names.slice(0, len(names) - 1), names.slice(1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a, nan_is_null=True), pc.is_null(b, nan_is_null=True)))
    return np.append(np.flatnonzero(~same.to_numpy(zero_copy_only=False)), len(names) - 1) + 1


def _alike(a: pa.Array, b: pa.Array) -> bool:
    return len(_ends(pa.concat_arrays([a, b]))) == 1


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, bool]]:
    """The pieces of sorted rows: the image's name, as an array of one, its rows' channels (NaN where missing), and whether they are the whole image."""
    held: list[np.ndarray] = []
    name, n, inside = None, 0, False
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in CHANNELS], 1)
        names, at = batch.column("image"), 0
        for end in _ends(names).tolist():
            here = names.slice(at, 1)
            if name is not None and not _alike(name, here):
                yield name, np.concatenate(held), inside
                held, n, inside = [], 0, True
            name = here
            while at < end:
                if n == PIECE:
                    # goes on: a larger image's last piece isn't whole either
                    yield name, np.concatenate(held), False
                    held, n, inside = [], 0, False
                take = min(end - at, PIECE - n)
                held.append(values[at : at + take])
                n, at = n + take, at + take
    if name is not None:
        yield name, np.concatenate(held), False


def one_type(names: Sequence[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(names) if names else pa.array([], kind)
