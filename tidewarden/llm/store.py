"""Intermediate tables in the shared folder, as in the rest of the library, and names that no column has."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewarden.shared import settle

__all__ = ["settle", "unused"]


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no column of the frames has it, in any case of letters."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
