"""Column headers in one style: pure driver work, then one ``toDF``."""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from clarifex.errors import SchemaError, ValidationError

# Words that get a suffix, as SQL reserves them.
RESERVED = ["select", "insert", "update", "delete", "drop", "table", "index", "where", "join", "sum", "count", "group", "by", "having", "limit"]
# Symbols and the words that they become.
SYMBOLS = {"%": "percent", "#": "num", "$": "usd", "&": "and", "@": "at", "+": "plus"}
# Terms that a mistyped header is matched with.
TERMS = ["id", "first_name", "last_name", "age", "gender", "email", "phone", "address", "city", "state", "zipcode", "country", "salary", "revenue", "profit", "date", "date_of_birth", "status", "category", "amount", "quantity", "price", "latitude", "longitude"]

STYLES = {
    "snake": lambda words: "_".join(words).lower(),
    "upper_snake": lambda words: "_".join(words).upper(),
    "camel": lambda words: words[0].lower() + "".join(w.capitalize() for w in words[1:]),
    "pascal": lambda words: "".join(w.capitalize() for w in words),
}


@dataclass
class SchemaOptimizer:
    """Names columns. Overrides are taken as they are; other headers go through all steps in order."""

    case_style: str = "snake"
    resolve_duplicates: bool = True
    sql_safe_mode: bool = True
    max_col_length: int = 63
    normalize_unicode: bool = True
    custom_regex_replacements: dict[str, str] | None = None
    ai_auto_correct: bool = False
    auto_correct_threshold: float = 0.8
    domain_dictionary: list[str] | None = None
    custom_columns_map: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.case_style = self.case_style.lower()
        if self.case_style not in STYLES:
            raise ValidationError(f"case_style is {self.case_style!r}; it must be one of {', '.join(STYLES)}")
        self.auto_correct_threshold = min(1.0, max(0.1, self.auto_correct_threshold))
        self.translation_ledger: dict[str, str] = {}

    def _styled(self, text: str) -> str:
        return STYLES[self.case_style](text.split("_")) if text else text

    def clean(self, header: object) -> str:
        """One header in style, not yet unique."""
        raw = "" if header is None or header != header else str(header).strip()
        if self.normalize_unicode:
            raw = unicodedata.normalize("NFKD", raw).encode("ascii", "ignore").decode()
        for symbol, word in (self.custom_regex_replacements or SYMBOLS).items():
            raw = raw.replace(symbol, f"_{word}_")
        plain = re.sub("[^a-z0-9]+", "_", raw.lower()).strip("_")
        if not plain:
            return "unnamed_col"
        if self.sql_safe_mode and plain in RESERVED:
            plain += "_col"
        return self._correct(self._styled(plain[: self.max_col_length].strip("_")))

    def _correct(self, styled: str) -> str:
        if not self.ai_auto_correct:
            return styled
        near = difflib.get_close_matches(styled.lower(), self.domain_dictionary or TERMS, n=1, cutoff=self.auto_correct_threshold)
        return self._styled(near[0]) if near else styled

    def unique(self, names: list[str]) -> list[str]:
        """Every member of a group of equal names is numbered; a number that another column has already is passed over.

        Names that differ in case alone are equal, as Spark resolves them alike.
        """
        counts, taken, numbers = Counter(n.lower() for n in names), set(), Counter()
        taken |= {n for n, k in counts.items() if k == 1}
        join = "" if self.case_style in ("camel", "pascal") else "_"
        out = []
        for n in names:
            if counts[n.lower()] == 1:
                out.append(n)
                continue
            while True:
                numbers[n.lower()] += 1
                suffix = f"{join}{numbers[n.lower()]}"
                free = n[: self.max_col_length - len(suffix)] + suffix
                if free.lower() not in taken:
                    break
            taken.add(free.lower())
            out.append(free)
        return out

    def optimize_metadata(self, columns: Iterable[object]) -> tuple[list[str], dict[str, str]]:
        """The new names of ``columns``, and new name -> old name as text."""
        old = list(columns)
        new = [self.custom_columns_map[c] if isinstance(c, str) and c in self.custom_columns_map else self.clean(c) for c in old]
        if self.resolve_duplicates:
            new = self.unique(new)
        self.translation_ledger = {n: str(o) for n, o in zip(new, old, strict=True)}
        return new, self.translation_ledger

    def evaluate(self, columns: Iterable[object], bypass: bool = False) -> bool:
        """Whether any name would change (and may)."""
        old = list(columns)
        return self.optimize_metadata(old)[0] != old and not bypass

    def optimize_dataframe(self, df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        """``df`` with new names, and the ledger; nested columns must be flattened first."""
        if nested := [f.name for f in df.schema.fields if isinstance(f.dataType, T.StructType)]:
            raise SchemaError(f"flatten nested columns first: {', '.join(nested)}")
        names, ledger = self.optimize_metadata(df.columns)
        return df.toDF(*names), ledger
