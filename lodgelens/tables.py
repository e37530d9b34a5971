"""The set of eleven tables that an analysis reads."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame

from lodgelens.schema import TABLE_NAMES


class HotelTables(Mapping[str, DataFrame]):
    """Eleven DataFrames by name, each opened on first use.

    An analysis that touches three tables lists and reads the files of three tables only.  Access is by
    attribute (``t.search_log``) or by key (``t["search_log"]``).
    """

    def __init__(self, opener: Callable[[str], DataFrame]):
        self._opener = opener
        self._opened: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, frames: Mapping[str, DataFrame]) -> HotelTables:
        """Wrap DataFrames that are already at hand; unused tables may be missing."""
        unknown = set(frames) - set(TABLE_NAMES)
        if unknown:
            raise ValueError(f"not a known table: {sorted(unknown)}")
        return cls(lambda name: frames[name])

    def replaced(self, **frames: DataFrame) -> HotelTables:
        """The same set with some tables exchanged, e.g. for a filtered or cached one."""
        return HotelTables(lambda name: frames[name] if name in frames else self[name])

    def __getitem__(self, name: str) -> DataFrame:
        if name not in TABLE_NAMES:
            raise KeyError(name)
        if name not in self._opened:
            self._opened[name] = self._opener(name)
        return self._opened[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self[name]
        except KeyError as missing:
            raise AttributeError(name) from missing

    def __iter__(self) -> Iterator[str]:
        return iter(TABLE_NAMES)

    def __len__(self) -> int:
        return len(TABLE_NAMES)
