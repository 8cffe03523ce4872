"""Engineering history: notes of documents and code markers that name known files or symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcegrain.functions import text as tx
from sourcegrain.functions.stages import hold
from sourcegrain.operators import facts as C
from sourcegrain.operators.passages import HEADING

# History words, headings, names in text.
KEYWORDS = (r"(?i)\b(legacy|deprecated|obsolete|predate[sd]?|replaced|scheduled for removal|no longer|superseded|migrat\w*|older|v1)\b")
HISTORY_HEADING = r"(?i)history|changelog|legacy|migration|deprecat|decision"
PATH = r"[\w./-]+\.(?:js|jsx|ts|tsx|mjs|cjs|py|go|rb|java|php|cs|rs|vue|svelte)\b"
SYMBOL = r"`([A-Za-z_$][\w$]*)(?:\(\))?`"


def documented_notes(parsed: DataFrame) -> DataFrame:
    """Lines of documents under history headings, or with history words, that name something known."""
    docs = parsed.where("kind = 'doc'")
    # heading state of each line inside the file row: number of the last heading at or before it
    heads = F.filter(F.transform("lines", lambda s, i: F.when(s.rlike(HEADING), F.struct(
        (i + 1).alias("no"), F.regexp_extract(s, HEADING, 1).rlike(HISTORY_HEADING).alias("on")))), lambda x: x.isNotNull())
    docs = hold(docs.select("repo_id", "path", "lines", F.array_contains("tags", "readme").alias("readme")), heads=heads)
    rows = docs.select("repo_id", "path", "readme", "heads", F.posexplode("lines").alias("i", "s")).withColumn("line", F.col("i") + 1)
    last = F.try_element_at(F.filter("heads", lambda h: h["no"] < F.col("line")), F.lit(-1))
    rows = rows.where(~F.col("s").rlike(HEADING) & F.col("s").rlike(r"\S") & (F.coalesce(last["on"], F.lit(False)) | F.col("s").rlike(KEYWORDS)))
    rows = hold(rows.select("repo_id", "path", "readme", "line", "s"), paths=F.array_distinct(F.regexp_extract_all("s", F.lit(PATH), F.lit(0))),
                names=F.array_distinct(F.regexp_extract_all("s", F.lit(SYMBOL), F.lit(1))))
    key = ["repo_id", "path", "line"]
    files = rows.select(*key, F.posexplode("paths").alias("o", "file")).join(parsed.select("repo_id", F.col("path").alias("file")), ["repo_id", "file"], "left_semi")
    known = C.table(parsed, "symbols").select("repo_id", "name").distinct()
    names = rows.select(*key, F.posexplode("names").alias("o", "name")).join(known, ["repo_id", "name"], "left_semi")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("o", c))), lambda x: x[c])
    out = (rows.join(files.groupBy(*key).agg(ordered("file").alias("files")), key, "left")
           .join(names.groupBy(*key).agg(ordered("name").alias("symbols")), key, "left")
           .where("files IS NOT NULL OR symbols IS NOT NULL"))
    note = F.substring(tx.strip(F.regexp_replace("s", r"^\s*(?:[-*+]|\d+\.)\s+", "")), 1, 300)
    none = F.array().cast("array<string>")
    return out.select(*key, note.alias("note"), F.coalesce("files", none).alias("files"), F.coalesce("symbols", none).alias("symbols"),
                      F.lit("documented").alias("kind"), F.when(F.col("readme"), 0).otherwise(1).alias("stage"))


def marker_notes(parsed: DataFrame) -> DataFrame:
    """Code markers with the symbol that starts within three lines, else the one around them."""
    rows = parsed.where("kind = 'source'").select("repo_id", "path", "symbols", F.explode("markers").alias("m"))
    following = F.try_element_at(F.filter("symbols", lambda s: (s["line_start"] >= F.col("m.line")) & (s["line_start"] <= F.col("m.line") + 3)), F.lit(1))
    rows = hold(rows, s=F.coalesce(following, C.symbol_at(F.col("symbols"), F.col("m.line"))))
    note = tx.strip(F.regexp_replace("m.text", "^[/#* ]+", ""))
    return rows.select("repo_id", "path", F.col("m.line").alias("line"), note.alias("note"), F.array("path").alias("files"),
                       F.when(F.col("s").isNull(), F.array().cast("array<string>")).otherwise(F.array("s.name")).alias("symbols"),
                       F.lit("code-marker").alias("kind"), F.lit(2).alias("stage"))


def notes(parsed: DataFrame, limit: int | None = None) -> DataFrame:
    """All notes, documents first; ``limit`` keeps the first ones of each repository."""
    whole = documented_notes(parsed).unionByName(marker_notes(parsed))
    if limit is not None:
        w = Window.partitionBy("repo_id").orderBy("stage", "path", "line")
        whole = whole.withColumn("ordinal", F.row_number().over(w)).where(F.col("ordinal") <= limit)
    return whole


def legacy_notes(all_notes: DataFrame) -> DataFrame:
    return all_notes.where(F.col("note").rlike(KEYWORDS))


def legacy_symbols(all_notes: DataFrame) -> DataFrame:
    """First legacy note of each symbol."""
    rows = legacy_notes(all_notes).select("repo_id", F.explode("symbols").alias("name"), "note", "path", "line", "stage")
    return rows.groupBy("repo_id", "name").agg(F.min_by(F.struct("note", "path", "line"), F.struct("stage", "path", "line")).alias("n")).select(
        "repo_id", "name", "n.*")


