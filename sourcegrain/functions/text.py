"""Text and hashing column helpers shared by every operator.

Line numbers are 1-based. Text splits on LF, CRLF and CR; one trailing empty line is dropped.
A line-range hash is SHA-256 over the lines joined by LF, each without trailing whitespace.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# UTF-8 byte order mark, whitespace.
UTF8_BOM_HEX = "EFBBBF"
WHITESPACE = " \t\n\x0b\f\r"  # what \s stands for in patterns


def strip(col: Column) -> Column:
    """Drop leading and trailing whitespace of every kind (``F.trim`` knows blanks only)."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def rstrip(col: Column) -> Column:
    return F.regexp_replace(col, r"\s+$", "")


def squash(col: Column) -> Column:
    """Runs of whitespace become one blank, ends trimmed."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def decode_source(content: Column) -> Column:
    """Bytes to text: byte order mark dropped, malformed UTF-8 replaced."""
    bom = F.hex(F.substring(content, 1, 3)) == F.lit(UTF8_BOM_HEX)
    body = F.when(bom, F.substring(content, F.lit(4), F.length(content))).otherwise(content)
    return F.make_valid_utf8(body.cast("string"))


def lstrip(col: Column) -> Column:
    """Drop leading whitespace, of the same kinds as ``strip``; nothing behind the first other character is looked at."""
    return F.ltrim(col, F.lit(WHITESPACE))


def split_lines(text: Column) -> Column:
    """The lines of a text. The split is bound by a lambda: as an expression used four times it would run four times."""
    whole = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    ended = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.element_at(F.transform(F.array(F.split(whole, "\n", -1)), ended), 1)


def slice_lines(lines: Column, start: Column, end: Column) -> Column:
    """Inclusive 1-based line range, clipped to the file."""
    first = F.greatest(start, F.lit(1))
    return F.slice(lines, first, F.greatest(F.least(end, F.size(lines)) - first + 1, F.lit(0)))


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def hash_lines(lines: Column) -> Column:
    return F.sha2(F.array_join(F.transform(lines, rstrip), "\n"), 256)


def hash_range(lines: Column, start: Column, end: Column) -> Column:
    return hash_lines(slice_lines(lines, start, end))


def is_binary(content: Column) -> Column:
    """NUL byte within the first 8192 bytes."""
    head = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")
    return F.instr(head, "\u0000") > 0


def count_of(text: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a literal; in bytes, as their number needs no count of characters."""
    return F.when(
        F.length(needle) > 0,
        ((F.octet_length(text) - F.octet_length(F.replace(text, needle, F.lit("")))) / F.octet_length(needle)).cast("int"),
    ).otherwise(F.lit(0))


def from_any(chars: str, pattern: str) -> str:
    """The same pattern, all of whose matches begin with one of ``chars``: elsewhere its branches are not tried."""
    return f"(?=[{chars}])(?:{pattern})"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dir_parts(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def suffix(name: Column) -> Column:
    """Last extension with its dot; names such as ``.env`` have none."""
    return F.regexp_extract(name, r"^.*[^.].*?(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension."""
    name = base_name(path)
    ext = suffix(name)
    return F.when(ext == "", name).otherwise(F.substring(name, F.lit(1), F.length(name) - F.length(ext)))


def drop_dot_slash(path: Column) -> Column:
    """Leading dots and slashes are dropped as characters, so ``.github/x`` becomes ``github/x``."""
    return F.regexp_replace(path, r"^[./]+", "")


def regex_quote(col: Column) -> Column:
    """Literal form of a column for a Java pattern."""
    return F.concat(F.lit("\\Q"), F.replace(col, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def ellipsis(col: Column, limit: int, keep: int) -> Column:
    """Text longer than ``limit`` keeps ``keep`` characters and a one-character ellipsis."""
    return F.when(F.length(col) <= limit, col).otherwise(F.concat(F.substring(col, 1, keep), F.lit("…")))
