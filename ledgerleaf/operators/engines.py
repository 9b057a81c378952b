"""Pluggable engines: named functions from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Engine = Callable[[DataFrame], DataFrame]


class EngineRegistry:
    """Engines by a stable name. An engine may add columns; it must keep those of its input."""

    def __init__(self) -> None:
        self._engines: dict[str, Engine] = {}

    def register(self, name: str, engine: Engine) -> None:
        if not name or name != name.strip() or "\n" in name:
            raise ValueError("an engine's name must be one stripped line")
        if name in self._engines:
            raise ValueError(f"there is an engine called {name!r}")
        self._engines[name] = engine

    def names(self) -> list[str]:
        return sorted(self._engines)

    def apply(self, name: str, df: DataFrame) -> DataFrame:
        """Run an engine; the schema shows at once if it dropped or changed an input column."""
        out = df.transform(self._engines[name])
        kept = {f.name: f.dataType for f in out.schema.fields}
        lost = [f.name for f in df.schema.fields if kept.get(f.name) != f.dataType]
        if lost:
            raise ValueError(f"engine {name!r} changed its input: {', '.join(lost)}")
        return out
