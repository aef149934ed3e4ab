"""Nested structs as flat columns, with a ledger that leads back. Only the schema is looked at, never the data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clarifex.errors import CollisionError, EngineError, ValidationError
from clarifex.functions.columns import name
from clarifex.plans.ledger import ShapeLedger


def leaf_paths(schema: T.StructType) -> list[tuple[str, ...]]:
    """The paths of all columns that are not structs, in order; an empty struct is a leaf."""
    out = []
    for f in schema.fields:
        inner = leaf_paths(f.dataType) if isinstance(f.dataType, T.StructType) else []
        out += [(f.name, *p) for p in inner] or [(f.name,)]
    return out


def field_at(path: tuple[str, ...]) -> Column:
    out = name(path[0])
    for level in path[1:]:
        out = out.getField(level)
    return out


@dataclass
class SchemaFlattener:
    """Flattens nested columns; ``evaluate`` (or ``generate_schema``) comes before ``transform``."""

    delimiter: str = "_"
    col_strategy: str = "join"
    reset_row_index: bool = True
    handle_sparse: bool = True
    drop_empty_levels: bool = False
    memory_safe_copy: bool = True
    collision_strategy: str = "rename"
    strip_whitespace: bool = True
    unnamed_prefix: str = "UNNAMED_LEVEL"

    def __post_init__(self) -> None:
        for option, value, known in (("col_strategy", self.col_strategy, ("join", "top", "bottom")), ("collision_strategy", self.collision_strategy, ("rename", "raise"))):
            if value not in known:
                raise ValidationError(f"{option} is {value!r}; it must be one of {', '.join(known)}")
        self.ledger: ShapeLedger | None = None

    def flat_name(self, path: tuple[object, ...]) -> str:
        """One name for a path: its levels cleaned and, by the strategy, joined, or the first or last alone."""
        chosen = {"join": path, "top": path[:1], "bottom": path[-1:]}[self.col_strategy]
        cleaned = [None if level is None or level != level else str(level).strip() if self.strip_whitespace else str(level) for level in chosen]
        fill = None if self.drop_empty_levels or not self.handle_sparse else self.unnamed_prefix
        kept = [level or fill for level in cleaned]
        return self.delimiter.join(level for level in kept if level) or self.unnamed_prefix

    def flat_names(self, paths: list[tuple[object, ...]]) -> list[str]:
        """Unique names for paths: the first keeps a name, those that come later get a number."""
        out: dict[str, None] = {}
        for path in paths:
            base = free = self.flat_name(path)
            number = 0
            while free in out:
                if self.collision_strategy == "raise":
                    raise CollisionError(f"two columns flatten to {free!r}; collision_strategy='rename' numbers them")
                number += 1
                free = f"{base}{self.delimiter}{number}"
            out[free] = None
        return list(out)

    def index_names(self, index: list[str | None]) -> list[str]:
        """Names of key levels: stripped; a level without one is numbered."""
        return [str(i).strip() if i is not None and str(i).strip() else f"{self.unnamed_prefix}_ROW_{k}" for k, i in enumerate(index)]

    def generate_schema(self, df: DataFrame, index: list[str] | None = None) -> ShapeLedger:
        """The ledger of ``df``; ``index`` names the top-level columns that are row keys rather than data."""
        index = list(index or [])
        paths = [p for p in leaf_paths(df.schema) if p[0] not in index]
        nested = any(len(p) > 1 for p in paths)
        flat = self.flat_names(paths) if nested else [p[0] for p in paths]
        keys = self.index_names(index)
        self._sources = [((i,), k) for i, k in zip(index, keys, strict=True)] + list(zip(paths, flat, strict=True))
        origins = {k: i if i.strip() else None for i, k in zip(index, keys, strict=True)}
        self.ledger = ShapeLedger(dict(zip(flat, paths, strict=True)) if nested else {}, tuple(keys), origins, nested or (len(index) > 1 and self.reset_row_index))
        return self.ledger

    def evaluate(self, df: DataFrame, bypass: bool = False, index: list[str] | None = None) -> bool:
        """Whether ``df`` needs flattening (and may have it); the ledger is made either way."""
        return self.generate_schema(df, index).needs_flattening and not bypass

    def transform(self, df: DataFrame, precomputed_headers: list[str] | None = None) -> DataFrame:
        """``df`` flat: one select, keys first. Columns are as they were if nothing is nested."""
        if self.ledger is None:
            raise EngineError("generate_schema comes before transform")
        if not self.ledger.needs_flattening:
            return df
        names = precomputed_headers or [flat for _, flat in self._sources]
        if len(names) != len(self._sources):
            raise ValidationError(f"{len(names)} headers for {len(self._sources)} columns")
        return df.select(*[field_at(path).alias(flat) for (path, _), flat in zip(self._sources, names, strict=True)])

    def flatten(self, df: DataFrame, index: list[str] | None = None) -> tuple[DataFrame, ShapeLedger]:
        """``df`` flat, and its ledger."""
        ledger = self.generate_schema(df, index)
        return self.transform(df), ledger


def flatten(df: DataFrame, index: list[str] | None = None, **options) -> tuple[DataFrame, ShapeLedger]:
    return SchemaFlattener(**options).flatten(df, index)


def nest(columns: list[tuple[tuple[str, ...], Column]]) -> list[Column]:
    """Columns with paths as (nested) struct columns; equal leaders next to each other or apart become one struct, at the first's place."""
    groups: dict[str, list[tuple[tuple[str, ...], Column]]] = {}
    for path, column in columns:
        groups.setdefault(path[0], []).append((path[1:], column))
    out = []
    for top, own in groups.items():
        if len(own) == 1 and not own[0][0]:
            out.append(own[0][1].alias(top))
        elif any(not rest for rest, _ in own):
            raise CollisionError(f"{top!r} is a column and a level above others")
        else:
            out.append(F.struct(*nest(own)).alias(top))
    return out
