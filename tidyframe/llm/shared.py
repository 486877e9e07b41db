"""What several corpus operators share: the shared folder, and walking over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

from ..dtypes import name, unused
from ..session import checkpointed, remove_folder, shared_folder, shuffle_partitions

__all__ = ["checkpointed", "name", "remove_folder", "shared_folder", "shuffle_partitions", "slices", "unused"]

#: Rows that become Python objects at a time; bounds a worker's memory when texts are long.
SLICE_ROWS = 256


def slices(batches: Iterator) -> Iterator:
    """Arrow record batches of at most SLICE_ROWS rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)
