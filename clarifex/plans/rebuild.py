"""The original shape again: key columns first, flat columns under their paths, new columns kept apart or dropped."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from clarifex.errors import ReconstructionError, ValidationError
from clarifex.functions.columns import name
from clarifex.plans.flatten import nest
from clarifex.plans.ledger import ShapeLedger


@dataclass
class SchemaReconstructor:
    """``unmapped_strategy``: columns that are new since the ledger are isolated under ``fallback_level_name``, or dropped.

    ``strict_validation``: an original column that is missing is an error.
    """

    strict_validation: bool = False
    unnamed_prefix: str = "UNNAMED_LEVEL"
    unmapped_strategy: str = "isolate"
    fallback_level_name: str = "AI_GENERATED"

    def __post_init__(self) -> None:
        if self.unmapped_strategy not in ("isolate", "drop"):
            raise ValidationError(f"unmapped_strategy is {self.unmapped_strategy!r}; it must be isolate or drop")

    def artifacts(self, df: DataFrame, ledger: ShapeLedger) -> list[str]:
        """The columns that the ledger does not know."""
        known = {*ledger.paths, *ledger.index_names}
        return [c for c in df.columns if c not in known] if ledger.paths else []

    def padded_paths(self, df: DataFrame, ledger: ShapeLedger, fill: str = "") -> dict[str, tuple[str, ...]]:
        """Each column's path with levels without a name as ``fill``, all of the depth of the deepest: for sinks with header rows."""
        new = set(self.artifacts(df, ledger))
        own = {c: (self.fallback_level_name, c) if c in new else tuple(fill if not p or self.unnamed_prefix in p else p for p in ledger.paths.get(c, (c,))) for c in df.columns if c not in ledger.index_names}
        deepest = max(map(len, own.values()), default=0)
        return {c: p + (fill,) * (deepest - len(p)) for c, p in own.items()}

    def rebuild(self, df: DataFrame, ledger: ShapeLedger | None, keep_optimized_headers: bool = False, unnamed_fill_value: str = "") -> DataFrame:
        """``df`` in the ledger's shape, by one select. An empty ledger, or one of a flat frame, leaves the columns as they are.

        Spark has no blank level names, so a level without a name takes ``unnamed_fill_value`` if that is
        not empty, and else keeps its placeholder.
        """
        if not ledger:
            return df
        missing = [c for c in (*ledger.paths, *ledger.index_names) if c not in df.columns]
        if self.strict_validation and missing:
            raise ReconstructionError(f"columns of the original are missing: {', '.join(missing)}")
        new = self.artifacts(df, ledger)
        keys = [c for c in ledger.index_names if c in df.columns]
        if self.unmapped_strategy == "drop":
            df = df.drop(*new)
            new = []
        if keep_optimized_headers:
            return df.select(*map(name, keys), *[name(c) for c in df.columns if c not in keys])
        placed = [((ledger.index_origins.get(k) or k,), name(k)) for k in keys]
        for c in df.columns:
            if c in keys or c in new:
                continue
            path = ledger.paths.get(c, (c,))
            placed.append((tuple(unnamed_fill_value or level or self.unnamed_prefix if level is None or self.unnamed_prefix in level else level for level in path), name(c)))
        nested = any(len(p) > 1 for p, _ in placed)
        placed += [((self.fallback_level_name, c) if nested else (c,), name(c)) for c in new]
        return df.select(*nest(placed))
