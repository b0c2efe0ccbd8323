"""Python workers are reused: what a task leaves free must not stay with the process."""

import numpy as np
import pyarrow as pa

from runlens.llm.common import slices


def _resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_slices_give_free_memory_back():
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 4)], ["text"])
    held = []
    for _ in slices(iter([batch]), "text"):
        held = [np.ones(8000) for _ in range(4000)]  # 64 KB each, from the heap
        top = [held[k].copy() for k in range(0, 4000, 100)]  # some stay, so that the heap can't shrink by itself
        full = _resident()
        held = None
    assert len(top) == 40 and full - _resident() > 100 << 20
