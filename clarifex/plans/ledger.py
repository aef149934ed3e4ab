"""What is remembered of an original schema, so that it can be restored."""

from __future__ import annotations

import json
from dataclasses import dataclass, field


@dataclass(frozen=True)
class ShapeLedger:
    """Flat column name -> path of levels (None for a level without a name), and the key columns in order."""

    paths: dict[str, tuple[str | None, ...]] = field(default_factory=dict)
    index_names: tuple[str, ...] = ()
    #: Key column -> its original name, None if it had none.
    index_origins: dict[str, str | None] = field(default_factory=dict)
    needs_flattening: bool = False

    def __bool__(self) -> bool:
        return bool(self.paths or self.index_names)

    def compose(self, renamed: dict[str, str]) -> ShapeLedger:
        """The ledger for columns that ``renamed`` (new name -> flat name) has renamed since; columns not in it keep their names."""
        back = {flat: new for new, flat in renamed.items()}
        now = lambda flat: back.get(flat, flat)
        return ShapeLedger({now(f): p for f, p in self.paths.items()}, tuple(map(now, self.index_names)), {now(f): o for f, o in self.index_origins.items()}, self.needs_flattening)

    def to_json(self) -> str:
        return json.dumps({"paths": self.paths, "index_names": self.index_names, "index_origins": self.index_origins, "needs_flattening": self.needs_flattening})

    @classmethod
    def from_json(cls, text: str) -> ShapeLedger:
        x = json.loads(text)
        return cls({k: tuple(p) for k, p in x["paths"].items()}, tuple(x["index_names"]), x["index_origins"], x["needs_flattening"])
