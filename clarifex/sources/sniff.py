"""What the head of a text file tells: encoding, delimiter, leading title lines, row weight."""

from __future__ import annotations

import csv
import io
import zipfile
import zlib
from collections import Counter
from dataclasses import dataclass, field

#: Bytes of the head that is looked at.
SNIFF_BYTES = 16384
# What is tried, in order.
ENCODINGS = ["utf-8", "latin-1", "iso-8859-1", "cp1252"]
DELIMITERS = [",", ";", "\t", "|", "^"]
#: Bytes of a row where the head has no lines.
ROW_BYTES = 250


@dataclass(frozen=True)
class Dialect:
    encoding: str = "utf-8"
    delimiter: str = ","
    skip_rows: int = 0
    row_bytes: int = ROW_BYTES
    compression: str = "none"
    header_lines: list[str] = field(default_factory=list)


def head_of(data: bytes, compression: str, size: int = SNIFF_BYTES) -> bytes:
    """The first bytes of the text in a file's head (gzip) or in its first member (zip, which needs the whole file)."""
    if compression == "gzip":
        return zlib.decompressobj(31).decompress(data, size)
    if compression == "zip":
        with zipfile.ZipFile(io.BytesIO(data)) as z, z.open(z.namelist()[0]) as f:
            return f.read(size)
    return data[:size]


def detect_encoding(head: bytes, encodings: list[str] | None = None) -> tuple[str, str]:
    """(encoding, decoded head). A character cut off by the head's end does not speak against an encoding."""
    for encoding in encodings or ENCODINGS:
        for cut in range(4):
            try:
                return encoding, head[: len(head) - cut].decode(encoding)
            except UnicodeDecodeError as e:
                if e.start < len(head) - cut - 4:
                    break
    return "unicode_escape", head.decode("unicode_escape", errors="replace")


def detect_delimiter(sample: str, delimiters: list[str] | None = None) -> str:
    """The delimiter that csv's sniffer finds, else the most frequent one in 20 lines, else a comma."""
    known = delimiters or DELIMITERS
    try:
        return csv.Sniffer().sniff(sample, "".join(known)).delimiter
    except csv.Error:
        text = "\n".join(sample.splitlines()[:20])
        votes = Counter({d: text.count(d) for d in known})
        best, n = max(votes.items(), key=lambda v: v[1])
        return best if n else ","


def detect_skip_rows(sample: str, delimiter: str) -> int:
    """Leading lines with fewer delimiters than lines usually have; blank lines among them count as lines."""
    lines = sample.splitlines()
    counts = [line.count(delimiter) for line in lines if line.strip()]
    usual = Counter(counts).most_common(1)[0][0] if counts else 0
    if not usual:
        return 0
    skip = next((k for k, line in enumerate(lines) if line.strip() and line.count(delimiter) >= usual), 0)
    return skip


def row_weight(sample: bytes) -> int:
    lines = sample.splitlines()
    return max(1, sum(map(len, lines)) // len(lines)) if lines else ROW_BYTES


def sniff(data: bytes, compression: str = "none", encodings: list[str] | None = None, delimiters: list[str] | None = None, skip_titles: bool = True, size: int = SNIFF_BYTES) -> Dialect:
    head = head_of(data, compression, size)
    encoding, text = detect_encoding(head, encodings)
    delimiter = detect_delimiter(text, delimiters)
    return Dialect(encoding, delimiter, detect_skip_rows(text, delimiter) if skip_titles else 0, row_weight(head), compression)
