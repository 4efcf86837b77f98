"""Ordered kernels: plain Python state machines that take one row of a key at a time.

A kernel has `inputs` (column names), `output` (a DDL schema), `start()`, `step(state, row)` giving the new state and the
rows to emit, and `finish(state)` giving the rows at the end of a series. States are plain data, so the batch and the
streaming runner (`cadence.operators.replay`, `cadence.streaming.runner`) drive the very same code.
"""
