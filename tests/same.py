"""Comparison of result tables."""

from __future__ import annotations


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{round(v, 6) + 0.0:.6f}"
    if hasattr(v, "__len__") and not isinstance(v, str):
        return str([_plain(x) for x in v])
    return str(v)


def rows_of(df):
    """Rows of a pandas frame as sorted tuples of strings, columns by name."""
    cols = sorted(df.columns)
    return cols, sorted(tuple(_plain(v) for v in r) for r in df[cols].itertuples(index=False))


def assert_same(got, want):
    (c1, r1), (c2, r2) = rows_of(got), rows_of(want)
    assert c1 == c2
    assert len(r1) == len(r2)
    bad = [(a, b) for a, b in zip(r1, r2) if a != b]
    assert not bad, bad[:3]
