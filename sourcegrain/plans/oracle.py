"""Common table expressions that the DuckDB oracles share."""

from __future__ import annotations

from sourcegrain.sources.corpus import DOCUMENT_SQL, NEXT_DOCUMENT_SQL, code_sql, next_code_sql


def split_sql(text: str) -> str:
    """List of lines of a text expression (LF, CRLF, CR; one trailing empty line dropped)."""
    parts = f"string_split(regexp_replace({text}, '\\r\\n?', chr(10), 'g'), chr(10))"
    return f"CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END"


def hash_sql(lines: str) -> str:
    """SHA-256 of a list of lines without trailing whitespace, joined by LF."""
    return f"sha256(array_to_string(list_transform({lines}, lambda x: regexp_replace(x, '\\s+$', '')), chr(10)))"


def _lines(name: str, source: str, *keep: str) -> str:
    cols = ", ".join(("repo_id", "path", *keep))
    return (f"{name} AS (SELECT {cols}, unnest(range(1, len(lines) + 1))::INT AS line_no, unnest(lines) AS line "
            f"FROM {source})")


DOCS = (f"docs AS (SELECT *, {split_sql('content')} AS lines, sha256(content) AS sha256, "
        f"strlen(content) AS size FROM ({DOCUMENT_SQL}))")
DOC_LINES = _lines("doc_lines", "docs", "language", "kind")
NEXT_DOCS = (f"next_docs AS (SELECT *, {split_sql('content')} AS lines, sha256(content) AS sha256, "
             f"strlen(content) AS size FROM ({NEXT_DOCUMENT_SQL}))")
NEXT_LINES = _lines("next_lines", "next_docs")
CODE = (f"code AS (SELECT *, {split_sql('content')} AS lines, sha256(content) AS sha256, "
        f"strlen(content) AS size FROM ({code_sql()}))")
CODE_LINES = _lines("code_lines", "code", "language", "kind")
NEXT_CODE = (f"next_code AS (SELECT *, {split_sql('content')} AS lines, sha256(content) AS sha256, "
             f"strlen(content) AS size FROM ({next_code_sql()}))")
_FILE = "repo_id, path, kind, language, lines, sha256"
# Both corpora of both snapshots, and their lines.
SNAPSHOTS = ", ".join([DOCS, NEXT_DOCS, CODE, NEXT_CODE, f"old_files AS (SELECT {_FILE} FROM code UNION ALL SELECT {_FILE} FROM docs)",
                       f"new_files AS (SELECT {_FILE} FROM next_code UNION ALL SELECT {_FILE} FROM next_docs)",
                       _lines("old_lines", "old_files", "language", "kind", "sha256"), _lines("new_lines", "new_files", "language", "kind", "sha256")])


def ctes(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
