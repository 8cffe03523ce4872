"""Hash-anchored passages. All work happens inside the file row: no shuffle, no join.

``lines`` and (for code) ``symbols`` are arrays of the file row; a passage is one exploded element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcegrain.functions import text as tx
from sourcegrain.functions.identifiers import expand_terms

# Passage geometry.
CODE_WINDOW, CODE_STEP = 40, 30
CONFIG_WINDOW = 60
SECTION_MAX = 60
HEADING = r"^\s{0,3}#{1,6}\s+(.*)$"


def _has_text(lines: Column) -> Column:
    return F.exists(lines, lambda s: s.rlike(r"\S"))


def _rows(df: DataFrame, spans: Column, memory_type: str, keep: list[str]) -> DataFrame:
    """Explode spans of (start, end, label, extra) into passages and drop blank ones."""
    part = tx.slice_lines(F.col("lines"), F.col("s.start"), F.col("s.end"))
    return (df.select(*keep, "lines", F.posexplode(spans).alias("_i", "s"))
            .where(_has_text(part))
            .select(*keep, F.lit(memory_type).alias("memory_type"), F.col("s.label").alias("symbol"),
                    F.col("s.start").alias("line_start"), F.col("s.end").alias("line_end"),
                    tx.join_lines(part).alias("content"), tx.hash_lines(part).alias("sha256"),
                    F.col("s.extra").alias("extra"), F.col("_i").alias("ordinal")))


def _span(start: Column, end: Column, label: Column | None = None, extra: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"),
                    (none if label is None else label).alias("label"), (F.lit("") if extra is None else extra).alias("extra"))


def windows(files: DataFrame, memory_type: str = "code", window: int = CODE_WINDOW, step: int = CODE_STEP,
            keep: tuple[str, ...] = ("repo_id", "path")) -> DataFrame:
    """Overlapping line windows; the last one ends at the end of the file."""
    total = F.size("lines")
    count = F.when(total == 0, 0).otherwise(1 + F.ceil(F.greatest(total - window, F.lit(0)) / step)).cast("int")
    starts = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: i * step + 1)).otherwise(
        F.array().cast("array<int>"))

    def make(start: Column) -> Column:
        end = F.least(total, start + window - 1)
        if "symbols" not in files.columns:
            return _span(start, end)
        touching = F.filter("symbols", lambda s: (s["line_start"] <= end) & (s["line_end"] >= start))
        return _span(start, end, None, F.array_join(F.array_distinct(F.transform(touching, lambda s: s["name"])), " "))

    return _rows(files, F.transform(starts, make), memory_type, list(keep))


def sections(files: DataFrame, keep: tuple[str, ...] = ("repo_id", "path")) -> DataFrame:
    """Markdown sections cut at headings, in chunks of at most ``SECTION_MAX`` lines."""
    total = F.size("lines")
    heads = F.filter(F.transform("lines", lambda s, i: F.when(s.rlike(HEADING), i + 1)), lambda x: x.isNotNull())
    cuts = F.when((F.size(heads) == 0) | (F.element_at(heads, 1) != 1), F.concat(F.array(F.lit(1)), heads)).otherwise(heads)

    def chunks(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get(F.col("_cuts"), i + 1) - 1, total)
        line = F.element_at("lines", start)
        label = F.when(line.rlike(HEADING), tx.strip(F.regexp_extract(line, HEADING, 1)))
        return F.transform(F.sequence(start, F.greatest(start, end), F.lit(SECTION_MAX)),
                           lambda c: _span(c, F.least(end, c + SECTION_MAX - 1), label))

    ready = files.where(total > 0).withColumn("_cuts", cuts)
    return _rows(ready, F.flatten(F.transform("_cuts", chunks)), "doc", list(keep))


def symbol_passages(files: DataFrame, keep: tuple[str, ...] = ("repo_id", "path"), max_lines: int | None = None) -> DataFrame:
    """One passage per symbol, of all its lines unless ``max_lines`` is set."""
    def last(s: Column) -> Column:
        return s["line_end"] if max_lines is None else F.least(s["line_end"], s["line_start"] + max_lines - 1)
    spans = F.transform("symbols", lambda s: _span(
        s["line_start"], last(s),
        F.when(s["parent"].isNotNull(), F.concat_ws(".", s["parent"], s["name"])).otherwise(s["name"]),
        F.concat_ws(" ", s["kind"], s["name"])))
    return _rows(files, spans, "symbol", list(keep))


def with_terms(passages: DataFrame) -> DataFrame:
    """Add searchable terms: parts of compound identifiers of content and path, plus names."""
    parts = F.array(F.array_join(expand_terms(F.col("content")), " "), F.array_join(expand_terms(F.col("path")), " "),
                    F.col("extra"))
    return passages.withColumn("terms", F.array_join(F.filter(parts, lambda p: p != ""), " ")).drop("extra")


def index(files: DataFrame, cap: int | None = None) -> DataFrame:
    """Passages of classified files with ``symbols``; optional cap per file, symbols first."""
    source = files.where("kind = 'source'")
    parts = [symbol_passages(source).withColumn("_rank", F.lit(0)), windows(source).withColumn("_rank", F.lit(1)),
             sections(files.where("kind = 'doc'")).withColumn("_rank", F.lit(1)),
             windows(files.where("kind IN ('config', 'manifest')").drop("symbols"), "config", CONFIG_WINDOW,
                     CONFIG_WINDOW).withColumn("_rank", F.lit(1))]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    if cap is not None:
        w = Window.partitionBy("repo_id", "path").orderBy("_rank", "ordinal")
        whole = whole.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")
    return with_terms(whole.drop("_rank"))


def index_stats(passages: DataFrame) -> DataFrame:
    """Passage counts per repository and type with totals."""
    return (passages.rollup("repo_id", "memory_type").agg(F.count("*").alias("passages"),
                                                          F.countDistinct("repo_id", "path").alias("files")))
