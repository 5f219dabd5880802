"""The practice's tables, as lazily evaluated DataFrames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from tallywork import schema


class Practice(Mapping):
    """A read-only set of named tables: ``db.visit`` or ``db["visit"]``.

    ``db.replaced(client=new)`` gives a set with another version of a table: every
    upkeep step is a new version, nothing is updated in place.
    """

    def __init__(self, tables: Mapping[str, DataFrame]):
        unknown = set(tables) - set(schema.COLUMNS)
        if unknown:
            raise KeyError(f"unknown tables: {sorted(unknown)}")
        self._tables = dict(tables)

    def __getitem__(self, name: str) -> DataFrame:
        return self._tables[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self._tables[name]
        except KeyError:
            raise AttributeError(name) from None

    def __iter__(self):
        return iter(self._tables)

    def __len__(self) -> int:
        return len(self._tables)

    def replaced(self, **tables: DataFrame) -> "Practice":
        return Practice({**self._tables, **tables})
