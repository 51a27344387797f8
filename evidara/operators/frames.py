"""Rows of grouped steps as pandas frames whose integers stay whole where some are null."""

from __future__ import annotations

import pandas as pd

KINDS = {"int": "Int32", "long": "Int64", "double": "Float64", "boolean": "boolean"}


def frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """rows as columns of a schema, 'name type, name type'; a nested type has no blank after its commas."""
    fields = [f.split(" ", 1) for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pd.DataFrame({name: pd.array(list(c), dtype=KINDS[kind]) if kind in KINDS else pd.Series(list(c), dtype=object) for (name, kind), c in zip(fields, columns)})
