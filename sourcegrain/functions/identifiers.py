"""Identifier splitting and compound-identifier terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sourcegrain.functions.stages import let

# Identifier shape and camel-case parts.
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]*"
CAMEL_PART = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|\d+"


def split_identifier(name: Column) -> Column:
    """``findUserByEmail`` to find, user, by, email; ``API_KEY`` to api, key."""
    parts = F.regexp_extract_all(F.replace(name, F.lit("_"), F.lit(" ")), F.lit(CAMEL_PART), F.lit(0))
    return F.transform(parts, F.lower)


def is_compound(token: Column) -> Column:
    """Has an inner underscore, or mixes cases with a capital after the first character."""
    def compound(core: Column) -> Column:
        mixed = core.rlike("[A-Z]") & core.rlike("[a-z]") & F.substring(core, F.lit(2), F.length(core)).rlike("[A-Z]")
        return core.contains("_") | mixed
    return let(F.regexp_replace(token, "^_+|_+$", ""), compound)


def expand_terms(text: Column, limit: int | None = None) -> Column:
    """Distinct parts (longer than one character) of compound identifiers, in order; the first ``limit`` where set."""
    tokens = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))), is_compound)
    parts = F.flatten(F.transform(tokens, split_identifier))
    distinct = F.array_distinct(F.filter(parts, lambda p: F.length(p) > 1))
    return distinct if limit is None else F.slice(distinct, 1, limit)
