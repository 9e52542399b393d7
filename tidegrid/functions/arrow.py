"""Sorted Arrow batches as column arrays, inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def columns(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    t = pa.Table.from_batches(parts)
    return {c: t.column(c).to_numpy(zero_copy_only=False) for c in t.column_names}


def starts(*cols: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before it."""
    s = np.ones(len(cols[0]), bool)
    if len(s):
        s[1:] = False
        for c in cols:
            s[1:] |= c[1:] != c[:-1]
    return s


def whole_groups(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict[str, np.ndarray]]:
    """Sorted Arrow batches as column arrays that never cut a group of equal keys in two."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        change = starts(*cols)
        change[0] = False
        cuts = np.flatnonzero(change)
        if held and any(held[-1].column(held[-1].schema.get_field_index(k))[-1].as_py() != c[0] for k, c in zip(keys, cols, strict=True)):
            yield columns(held)
            held = []
        if len(cuts):
            yield columns([*held, b.slice(0, int(cuts[-1]))])
            held = [b.slice(int(cuts[-1]))]
        else:
            held.append(b)
    if held:
        yield columns(held)


def gathered(groups: Iterable[dict[str, np.ndarray]], rows: int) -> Iterator[dict[str, np.ndarray]]:
    """Column arrays put together until they have `rows` rows."""
    held: list[dict[str, np.ndarray]] = []
    size = 0
    for c in groups:
        held.append(c)
        size += len(next(iter(c.values())))
        if size >= rows:
            yield {k: np.concatenate([h[k] for h in held]) for k in c}
            held, size = [], 0
    if held:
        yield {k: np.concatenate([h[k] for h in held]) for k in held[0]}


def pieces(batches: Iterable[pa.RecordBatch], group: tuple[str, ...], row: tuple[str, ...], rows: int) -> Iterator[tuple[dict[str, np.ndarray], bool, bool]]:
    """(columns, first group may have begun before, last one may go on) of about `rows` sorted rows at a time.

    Cuts fall between groups where there is a choice, else between rows that differ in `row`. The ends of the partition count as open."""
    held: list[pa.RecordBatch] = []
    size, enough, opened = 0, rows, True
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < enough:
            continue
        c = columns(held)
        first = starts(*(c[k] for k in group))
        cut, inside = int(np.flatnonzero(first)[-1]), False
        if not cut:
            cut, inside = int(np.flatnonzero(starts(*(c[k] for k in row)))[-1]), True
        if not cut:  # one and the same row so far
            enough *= 2
            continue
        yield {k: x[:cut] for k, x in c.items()}, opened, inside
        held = pa.Table.from_batches(held).slice(cut).to_batches()
        size, enough, opened = size - cut, rows, inside
    if held:
        yield columns(held), opened, True
