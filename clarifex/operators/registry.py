"""Tools by name: functions (DataFrame, column, context) -> DataFrame that plan, and at most fit, one column's cleaning."""

from __future__ import annotations

import inspect
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame

from clarifex.errors import UnknownToolError, ValidationError

#: Columns that the tools work with besides their own, and what they may assume.
Tool = Callable[[DataFrame, str, "ToolContext"], DataFrame]


@dataclass(frozen=True)
class ToolContext:
    """What a tool may know besides its column.

    order_by, partition_by: the columns that order rows (tools that depend on order refuse to run without)
    and that divide them. exact: exact quantiles rather than approximate ones. seed: of all that draws.
    """

    order_by: tuple[str, ...] = ()
    partition_by: tuple[str, ...] = ()
    exact: bool = True
    seed: int = 1
    options: dict = field(default_factory=dict)

    def need_order(self, tool: str) -> tuple[str, ...]:
        if not self.order_by:
            raise ValidationError(f"{tool} depends on the order of rows: give order_by")
        return self.order_by


_TOOLS: dict[str, Tool] = {}


def register(name: str) -> Callable[[Tool], Tool]:
    """Decorator: make a function the tool ``name``. Functions of (df, column) are taken too."""

    def keep(tool: Callable) -> Callable:
        if name in _TOOLS:
            warnings.warn(f"tool {name!r} is registered anew", stacklevel=2)
        takes = len(inspect.signature(tool).parameters)
        _TOOLS[name] = tool if takes > 2 else lambda df, column, context: tool(df, column)
        return tool

    return keep


def register_tool(name: str, tool: Callable) -> None:
    register(name)(tool)


def get_tool(name: str) -> Tool:
    if name not in _TOOLS:
        raise UnknownToolError(f"no tool is called {name!r}")
    return _TOOLS[name]


def list_tools() -> list[str]:
    return sorted(_TOOLS)


def missing_tools(blueprint: dict[str, dict]) -> list[str]:
    """The tools that a blueprint names and nobody registered."""
    named = {t for rules in blueprint.values() for t in rules.get("cleaning_pipeline", [])}
    named |= {"type_caster"} if any(rules.get("memory_optimization") for rules in blueprint.values()) else set()
    return sorted(named - _TOOLS.keys())


def from_pandas(tool: Callable[[pd.DataFrame, str], pd.DataFrame], schema: str | None = None) -> Tool:
    """A tool from a function on pandas frames, which sees one batch at a time and so must not fit anything; ``schema`` if it changes columns."""

    def run(df: DataFrame, column: str, context: ToolContext) -> DataFrame:
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield tool(batch, column)

        return df.mapInPandas(each, schema or df.schema)

    return run
