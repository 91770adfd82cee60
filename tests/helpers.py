from __future__ import annotations

import numbers

import pandas as pd


def plain(x):
    """A value in a form that Spark and DuckDB share."""
    if isinstance(x, (list, tuple)) or getattr(x, "ndim", 0):
        return [plain(y) for y in x]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    if x is None or pd.isna(x):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return bool(x)
    return round(float(x), 9) if isinstance(x, numbers.Number) else str(x)


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    rows = lambda df: sorted(repr([plain(x) for x in r]) for r in df[sorted(df.columns)].itertuples(index=False))
    assert rows(a) == rows(b)
