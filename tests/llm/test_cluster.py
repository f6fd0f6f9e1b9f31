"""Task functions that give their memory back."""

import pyarrow as pa
import pytest

from lumenframe.llm.cluster import released


def test_released_passes_batches_on():
    batches = [pa.RecordBatch.from_pydict({"a": [i]}) for i in range(3)]
    assert list(released(iter)(iter(batches))) == batches
    assert list(released(iter)(iter([]))) == []


def test_released_passes_errors_on():
    def run(batches):
        yield next(batches)
        raise ValueError("broken")

    with pytest.raises(ValueError, match="broken"):
        list(released(run)(iter([pa.RecordBatch.from_pydict({"a": [1]})])))
