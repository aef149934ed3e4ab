"""Reading a file or folder into a DataFrame, whatever its dialect."""

from __future__ import annotations

import csv
import gzip
import io
import warnings
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import islice

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clarifex.errors import FormatError, MemoryLimitError, SecurityError, ValidationError
from clarifex.functions.columns import NULL_TOKENS, name, null_standardize
from clarifex.sources.excel import ExcelDataSource
from clarifex.sources.sniff import SNIFF_BYTES, Dialect, head_of, sniff

TEXTS, BOOKS = (".csv", ".tsv", ".txt"), (".xlsx", ".xls")
#: Bytes of a workbook, which is read whole on the driver, at most.
WHOLE_BYTES = 256 << 20
#: Encodings that Spark's readers know, by the names that are sniffed.
SPARK_ENCODINGS = {"latin-1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1", "utf-8": "UTF-8"}
#: Policies for lines with too many fields.
POLICIES = ("skip", "warn", "error")


@dataclass
class DataLoader:
    """A source and how to read it. ``load`` gives the DataFrame; arguments about chunks, cores and memory are advice that Spark does not need.

    fault_tolerance is about lines with more fields than the header: skip and warn drop them, error fails.
    Shorter lines are filled with nulls. Text columns are typed after null tokens are taken out.
    A folder is read as its first file says: its format, dialect and compression. Text is split among
    tasks line by line; where a quoted field has a line break, and for zip archives and encodings that
    Spark does not know, a file (of at most 2 GB, Spark's bound for one value) is one task.
    """

    spark: SparkSession
    filepath: str
    chunk_size: int | str | None = None
    max_cores: int | None = None
    ram_safety_margin: float = 0.5
    fallback_encodings: list[str] | None = None
    possible_delimiters: list[str] | None = None
    fault_tolerance: str = "skip"
    memory_backend: str = "spark"
    sniff_bytes: int = SNIFF_BYTES
    detect_metadata_headers: bool = True
    standardize_nulls: bool = True
    cache_in_memory: bool = False
    infer_types: bool = True
    dialect: Dialect = field(default=None, init=False)

    def __post_init__(self) -> None:
        self.ram_safety_margin = max(0.1, min(self.ram_safety_margin, 0.9))
        if self.fault_tolerance not in POLICIES:
            raise ValidationError(f"fault_tolerance is {self.fault_tolerance!r}; it must be one of {', '.join(POLICIES)}")
        jvm = self.spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(str(self.filepath))
        try:
            self._fs = self._path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            status = self._fs.getFileStatus(self._path)
        except Exception as e:
            raise SecurityError(f"{self.filepath} cannot be opened") from e
        self.is_folder, self.bytes = status.isDirectory(), status.getLen()
        if not self.is_folder and not self.bytes:
            raise SecurityError(f"{self.filepath} is empty")
        self.suffix, self.compression = self._kind(str(self.filepath))
        if self.is_folder:
            held = sorted((f.getPath().getName(), f) for f in self._fs.listStatus(self._path) if f.isFile() and f.getLen() and f.getPath().getName()[0] not in "._")
            if held:
                self._path, self.bytes = held[0][1].getPath(), held[0][1].getLen()
                inner, self.compression = self._kind(held[0][0])
                self.suffix = self.suffix if self.suffix in (*TEXTS, ".json", ".jsonl", ".parquet", ".pq") else inner
        self.dialect = Dialect(compression=self.compression)
        if self.suffix in TEXTS and self.bytes:
            head = self._zip_head() if self.compression == "zip" else self._bytes(max(self.sniff_bytes, 1 << 16))
            found = sniff(head, "none" if self.compression == "zip" else self.compression, self.fallback_encodings, self.possible_delimiters, self.detect_metadata_headers, self.sniff_bytes)
            self.dialect = replace(found, compression=self.compression)
        self._cached: DataFrame | None = None

    @staticmethod
    def _kind(path: str) -> tuple[str, str]:
        """(suffix, compression). A compressed file counts as what the name before says, as text if it says nothing."""
        low = path.lower().rstrip("/")
        packed = {".gz": "gzip", ".zip": "zip"}.get(low[low.rfind(".") :], "none")
        inner = low[: low.rfind(".")] if packed != "none" else low
        dot = inner.rfind(".")
        suffix = inner[dot:] if dot > inner.rfind("/") else ""
        return (suffix if packed == "none" or suffix in (*TEXTS, ".json", ".jsonl") else ".csv"), packed

    def _bytes(self, most: int) -> bytes:
        if most > WHOLE_BYTES:
            raise MemoryLimitError(f"{self.filepath} is read whole and has over {WHOLE_BYTES} bytes")
        stream = self._fs.open(self._path)
        try:
            return bytes(stream.readNBytes(min(most, self.bytes)))
        finally:
            stream.close()

    @property
    def safe_config(self) -> dict:
        """How the source is read."""
        return {"encoding": self.dialect.encoding, "delimiter": self.dialect.delimiter, "skiprows": self.dialect.skip_rows, "compression": self.compression, "na_values": NULL_TOKENS if self.standardize_nulls else None}

    def _zip_head(self) -> bytes:
        """The first bytes of the archive's first member, unpacked by an executor."""
        size = max(self.sniff_bytes, 1 << 16)

        def head(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in files:
                for content in batch["content"]:
                    with zipfile.ZipFile(io.BytesIO(content)) as z, z.open(z.namelist()[0]) as f:
                        yield pd.DataFrame({"head": [f.read(size)]})

        return bytes(self.spark.read.format("binaryFile").load(str(self._path)).select("content").mapInPandas(head, "head binary").first()[0])

    def _head_lines(self) -> list[str]:
        head = self._zip_head() if self.compression == "zip" else head_of(self._bytes(max(self.sniff_bytes, 1 << 16)), self.compression, 1 << 20)
        return head.decode(self.dialect.encoding, errors="replace").removeprefix("\ufeff").splitlines()

    def _whole_files(self, ahead: int, columns: list[str]) -> DataFrame:
        """Fields as texts, parsed a file at a time by Python; the first ``ahead`` lines are left out."""
        sep, encoding, compression = self.dialect.delimiter, self.dialect.encoding, self.compression

        def records(content: bytes) -> Iterator[list[str]]:
            if compression == "zip":
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    content = z.read(z.namelist()[0])
            elif compression == "gzip":
                content = gzip.decompress(content)
            lines = io.TextIOWrapper(io.BytesIO(content), encoding, newline="")
            for _ in islice(lines, ahead):
                pass
            return csv.reader(lines, delimiter=sep)

        def parsed(files: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            csv.field_size_limit(2**31 - 1)
            for batch in files:
                for content in batch["content"]:
                    rows = (r for r in records(content) if any(x.strip() for x in r) or len(r) > 1)
                    while some := list(islice(rows, 10_000)):
                        yield pd.DataFrame([[x or None for x in r[: len(columns)]] + [None] * (len(columns) - len(r)) for r in some], columns=columns, dtype=object)

        return self.spark.read.format("binaryFile").load(str(self.filepath)).select("content").mapInPandas(parsed, ", ".join(f"{c} string" for c in columns))

    def _breaks_lines(self) -> bool:
        """Whether a quoted field may have a line break: a line then has an odd number of quotes."""
        quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        return bool(self.spark.read.text(str(self.filepath)).where(quotes % 2 == 1).take(1))

    def _csv(self) -> DataFrame:
        sep, skip = self.dialect.delimiter, self.dialect.skip_rows
        options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
        lines = self._head_lines()
        at = next((k for k, line in enumerate(lines) if k >= skip and line.strip()), 0)  # the header's place
        names = next(csv.reader([lines[at]], delimiter=sep)) if lines else []
        columns = [f"c{k}" for k in range(len(names) + 1)]  # one more shows lines that are too long
        schema, encoding = ", ".join(f"{c} string" for c in columns), SPARK_ENCODINGS.get(self.dialect.encoding)
        if not encoding or self.compression == "zip" or (skip and (self.is_folder or encoding != "UTF-8")) or ((broken := self._breaks_lines()) and skip):
            rows = self._whole_files(at + 1, columns)
        elif not skip:
            rows = self.spark.read.options(**options, header=True, encoding=encoding, multiLine=broken).schema(schema).csv(str(self.filepath))
        else:
            # Titles and header stand in the file's first block, the first of its partition; they go by their place.
            place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
            text = self.spark.read.text(str(self.filepath)).select("value", F.col("_metadata.file_block_start").alias("block"), place.alias("place"))
            text = text.where(((F.col("block") > 0) | (F.col("place") > at)) & (F.length(F.trim("value")) > 0))
            rows = text.select(F.from_csv("value", schema, options).alias("r")).select("r.*")
        extra = F.col(columns[-1]).isNotNull()
        if self.fault_tolerance == "error":
            extra = F.when(extra, F.raise_error(F.lit("a line has more fields than the header"))).otherwise(False)
        elif self.fault_tolerance == "warn" and (bad := rows.where(extra).count()):
            warnings.warn(f"{bad} lines with more fields than the header are left out", stacklevel=3)
        flat = rows.where(~extra).drop(columns[-1])
        return self._tidy(flat.toDF(*self._unique(names)))

    @staticmethod
    def _unique(names: list[str]) -> list[str]:
        out: list[str] = []
        for k, n in enumerate(names):
            base = n.strip() or f"Unnamed: {k}"
            free, number = base, 0
            while free.lower() in {x.lower() for x in out}:
                number += 1
                free = f"{base}.{number}"
            out.append(free)
        return out

    def _tidy(self, df: DataFrame, dates: bool = False) -> DataFrame:
        """Null tokens taken out, then types found by one pass over all columns; timestamps only if the format has ``dates``."""
        if self.standardize_nulls:
            df = df.select(*[null_standardize(name(c)).alias(c) if t == "string" else name(c) for c, t in df.dtypes])
        texts = [c for c, t in df.dtypes if t == "string"]
        if not self.infer_types or not texts:
            return df
        kinds = [("bigint", r"^\s*[+-]?\d{1,18}\s*$"), ("double", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), ("boolean", r"^(?i)(true|false)$")]
        kinds += [("timestamp_ntz", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$")] * dates
        found = df.agg(*[F.count_if(name(c).isNotNull() & ~F.coalesce(name(c).rlike(p), F.lit(False))).alias(f"k{i}_{t}") for i, c in enumerate(texts) for t, p in kinds], *[F.count(name(c)).alias(f"n{i}") for i, c in enumerate(texts)]).first()
        casts = {}
        for i, c in enumerate(texts):
            if found[f"n{i}"]:
                casts |= {c: next((t for t, _ in kinds if not found[f"k{i}_{t}"]), "string")}
        return df.select(*[F.trim(name(c)).cast(casts[c]).alias(c) if casts.get(c, "string") != "string" else name(c) for c in df.columns])

    def _json(self) -> DataFrame:
        head = b"" if self.is_folder else self._bytes(1 << 16)
        if self.compression == "gzip":
            head = head_of(head, "gzip")
        array = head.lstrip(b"\xef\xbb\xbf \t\r\n")[:1] == b"["
        return self.spark.read.option("multiLine", array).json(str(self.filepath))

    def _excel(self) -> DataFrame:
        if self.suffix == ".xls":
            raise FormatError("old .xls workbooks are not read; save the workbook as .xlsx")
        self.spark.dataSource.register(ExcelDataSource)
        return self._tidy(self.spark.read.format(ExcelDataSource.name()).option("data", self._bytes(self.bytes).hex()).load(), dates=True)

    def load(self) -> DataFrame:
        """The source as a DataFrame; the same one again if it is cached."""
        if self._cached is not None:
            return self._cached
        if self.suffix in TEXTS:
            out = self._csv()
        elif self.suffix in BOOKS:
            out = self._excel()
        elif self.suffix in (".json", ".jsonl"):
            out = self._json()
        elif self.suffix in (".parquet", ".pq") or self.is_folder:
            out = self.spark.read.parquet(str(self.filepath))
        else:
            raise FormatError(f"{self.suffix or 'a file without a suffix'} is no format that can be read")
        if self.cache_in_memory:
            self._cached = out.persist(StorageLevel.MEMORY_AND_DISK)
        return out

    def reset(self) -> DataFrame:
        """The source from its beginning: a DataFrame has no position, so it is read again or taken from the cache."""
        return self.load()


def read(spark: SparkSession, source: str | DataFrame, **options) -> DataFrame:
    """A path or a DataFrame as a DataFrame."""
    return source if isinstance(source, DataFrame) else DataLoader(spark, str(source), **options).load()
