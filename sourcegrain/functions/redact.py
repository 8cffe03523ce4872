"""Secret redaction and safe rendering of text for export."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Redaction patterns.
PRIVATE_KEY_BLOCK = r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----"
ASSIGNMENT = (r"""(?i)((?:api[_-]?key|secret|passwd|password|token|private[_-]?key|access[_-]?key|client[_-]?secret)"""
              r"""[A-Za-z0-9_]*['"]?\s*[:=]\s*)(['"`])([^'"`\s]{4,})(\2)""")
KNOWN_KEYS = (r"(sk-(?:live|proj|test)?[A-Za-z0-9_\-]{16,}|AKIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}"
              r"|github_pat_[A-Za-z0-9_]{40,}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_\-]{35})")


def redact(text: Column) -> Column:
    text = F.regexp_replace(text, PRIVATE_KEY_BLOCK, "[REDACTED PRIVATE KEY]")
    text = F.regexp_replace(text, ASSIGNMENT, "$1$2[REDACTED]$4")
    return F.regexp_replace(text, KNOWN_KEYS, "[REDACTED]")


def number_lines(lines: Column, start: int = 1) -> Column:
    """Lines with a right-aligned number of at least four characters."""
    def one(line: Column, i: Column) -> Column:
        n = (i + start).cast("string")
        return F.concat(F.lpad(n, F.greatest(F.lit(4), F.length(n)), F.lit(" ")), F.lit(" | "), line)
    return F.array_join(F.transform(lines, one), "\n")


def neutralise(text: Column, tag: str = "repository_content") -> Column:
    """Delimiters of the export wrapper inside the text lose their meaning."""
    text = F.replace(text, F.lit(f"</{tag}>"), F.lit(f"<\\/{tag}>"))
    return F.replace(text, F.lit(f"<{tag}>"), F.lit(f"<\\{tag}>"))
