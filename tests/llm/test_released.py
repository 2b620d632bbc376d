"""A finished task of a Python step gives back what it has freed."""

import numpy as np

from tabbridge.llm.staging import released


def _resident():
    with open("/proc/self/status") as lines:
        return next(int(x.split()[1]) for x in lines if x.startswith("RssAnon")) / 1024


def test_freed_memory_goes_back():
    def step(batches):
        for batch in batches:
            parts = [np.ones(2_000) for _ in range(12_000)]  # some 190 MB in pieces too small to be mapped
            kept.append(np.ones(2_000))  # stands behind them, so they can't go by themselves
            parts.clear()
            yield batch

    kept, before = [], _resident()
    run = released(step)(iter([1]))
    assert next(run) == 1
    held = _resident() - before
    assert list(run) == []
    assert _resident() - before < min(40, held / 2)
