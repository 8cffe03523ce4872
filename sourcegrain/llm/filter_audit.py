"""Filter interaction audit by recursive enumeration of filter orders.

Each document is reduced to a cell: its part, the bits of the filters that it fails, and its labels. A recursive
common table expression extends filter prefixes by the unused letters; every row carries a mask cell and the bits
applied so far, and each level tells what its last filter does to that cell. Prefixes and masks are few whatever the
input (326 prefixes of five filters, 32 masks); the counts of the parts join them by mask afterwards.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcegrain.session import stored

MAX_FILTERS = 6  # 1,957 prefixes x 64 masks; the recursion's own limit is a million rows

_WORD = r"[^ \t-\r]+"


def quality_filters(text: Column) -> dict[str, Column]:
    """Failure conditions by letter: few words, repeated words, capitals, markup characters.

    Words are maximal runs without space, tab and line breaks (x20, x09-x0D), compared as they are written. An empty
    text fails only A.
    """
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    n = F.size(words).cast("long")
    return {"A": n < 50,
            "B": F.size(F.array_distinct(words)).cast("long") * 100 < n * 65,
            "C": F.regexp_count(text, F.lit("[A-Z]")).cast("long") * 100 > F.length(text).cast("long") * 5,
            "D": text.rlike("[#$%&*|]")}


def cells(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, repeated: str = "E", id_column: str = "doc_id",
          text_column: str = "text", part_column: str = "source") -> tuple[DataFrame, list[str]]:
    """(part, mask, docs, good, toxic): documents by part and failed filters, and the letters in the order of their bits.

    ``filters`` gives each letter's failure condition over the column ``text`` (null: empty). A document fails
    ``repeated`` if a smaller id has the same text anywhere in the table; rows that repeat the smallest id of a text
    all pass, rows without id pass only where no row with that text has one. Parts are ``part_column`` as text (null: empty string). ``labels`` has
    doc_id, quality and toxic; a document is good (toxic) if any row of its id says 1, else not. Other columns of
    both tables are ignored. No document: no cells.
    """
    filters = quality_filters(F.col("text")) if filters is None else filters
    letters = sorted([*filters, repeated])
    if len(set(letters)) != len(letters) or len(letters) > MAX_FILTERS or any(len(x) != 1 for x in letters):
        raise ValueError(f"at most {MAX_FILTERS} filters, each of one letter of its own")
    bit = {x: 1 << n for n, x in enumerate(letters)}
    text = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    mask = sum((F.coalesce(c, F.lit(False)).cast("int") * bit[x] for x, c in filters.items()), F.lit(0))
    rows = stored(text.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")))

    # Of a text only rows of its smallest id pass: counted apart, so that no task sees all rows of a common text.
    first = rows.groupBy("digest").agg(F.min("id").alias("id"))
    digest_and_id = (F.col("r.digest") == F.col("f.digest")) & F.col("r.id").eqNullSafe(F.col("f.id"))
    passing = rows.alias("r").join(first.alias("f"), digest_and_id, "left_semi").withColumn("sign", F.lit(1))
    signed = rows.withColumn("sign", F.lit(0)).unionByName(passing)

    marked = (labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
              .where((F.col("good") | F.col("toxic")) & F.col("id").isNotNull())
              .groupBy("id").agg(F.max(F.coalesce("good", F.lit(False))).alias("good"), F.max(F.coalesce("toxic", F.lit(False))).alias("toxic")))

    def counted(some: DataFrame, good: Column, toxic: Column) -> DataFrame:
        """Passing rows move from the mask with the bit of ``repeated`` to the one without."""
        here, passes = F.when(F.col("sign") == 0, 1).otherwise(-1), F.col("sign")
        held = some.select("part", "mask", here.alias("failing"), passes.alias("passing"), good.alias("good"), toxic.alias("toxic"))
        return held.groupBy("part", "mask", "good", "toxic").agg(F.sum("failing").alias("failing"), F.sum("passing").alias("passing"))

    no = F.lit(False)
    with_id = signed.where(F.col("id").isNotNull()).join(marked, "id", "left")
    both = counted(with_id, F.coalesce("good", no), F.coalesce("toxic", no)).unionByName(
        counted(signed.where(F.col("id").isNull()), no, no))
    split = both.select("part", "good", "toxic", F.explode(F.array(
        F.struct(F.col("mask").bitwiseOR(F.lit(bit[repeated])).alias("mask"), F.col("failing").alias("n")),
        F.struct(F.col("mask"), F.col("passing").alias("n")))).alias("c"))
    found = split.groupBy("part", F.col("c.mask").alias("mask")).agg(
        F.sum("c.n").alias("docs"), F.sum(F.when(F.col("good"), F.col("c.n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("c.n")).otherwise(0)).alias("toxic"))
    return found, letters


_WALK = """
WITH RECURSIVE walk (prefix, applied, step, mask, kept, removed, redundant, unique_fails) AS (
  SELECT '', 0, 0, mask, 1, 0, 0, 0 FROM {masks}
  UNION ALL
  SELECT concat(prefix, f.letter), applied | f.bit, step + 1, mask,
    CASE WHEN mask & (applied | f.bit) = 0 THEN 1 ELSE 0 END,
    CASE WHEN mask & applied = 0 AND mask & f.bit <> 0 THEN 1 ELSE 0 END,
    CASE WHEN mask & applied <> 0 AND mask & f.bit <> 0 THEN 1 ELSE 0 END,
    CASE WHEN mask = f.bit THEN 1 ELSE 0 END
  FROM walk LATERAL VIEW inline(filter({letters}, x -> applied & x.bit = 0)) f AS letter, bit
)
SELECT prefix, step, mask, kept, removed, redundant, unique_fails FROM walk WHERE step > 0
"""


def audit(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column] | None = None, repeated: str = "E", id_column: str = "doc_id",
          text_column: str = "text", part_column: str = "source") -> DataFrame:
    """What each filter removes in each order: one row per part, order of the letters and step, zeros included.

    Columns: part, filter_order, step (from 1), kept, removed, redundant (fails the step's filter, removed earlier),
    unique_fails (fails that filter only), good_lost, toxic_lost, shapley (removed by that filter, summed over all
    orders). See ``cells`` for nulls, repeated rows, ties and labels; an empty table gives no rows.
    """
    found, letters = cells(docs, labels, filters, repeated, id_column, text_column, part_column)
    found = stored(found)
    spark = docs.sparkSession
    entries = ", ".join(f"named_struct('letter', '{x}', 'bit', {1 << n})" for n, x in enumerate(letters))
    walk = spark.sql(_WALK.format(masks="{masks}", letters=f"array({entries})"), masks=found.select("mask").distinct())
    effects = stored(walk)

    n = F.col("docs")
    steps = effects.join(found, "mask").groupBy("part", "prefix", "step").agg(
        *[F.sum(n * F.col(x)).alias(x) for x in ("kept", "removed", "redundant", "unique_fails")],
        F.sum(F.col("good") * F.col("removed")).alias("good_lost"), F.sum(F.col("toxic") * F.col("removed")).alias("toxic_lost"))
    steps = stored(steps)
    whole = effects.where(F.col("step") == len(letters)).select(F.col("prefix").alias("filter_order")).distinct()
    orders = whole.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias("step"))
    orders = orders.select("filter_order", F.substring(F.col("filter_order"), F.lit(1), F.col("step")).alias("prefix"))
    rows = steps.join(orders, "prefix").withColumn("letter", F.substring("prefix", -1, 1))
    # A prefix stands in as many orders as the letters after it have; five filters: 120 orders.
    through = F.factorial(F.lit(len(letters)) - F.col("step"))
    shares = steps.groupBy("part", F.substring("prefix", -1, 1).alias("letter")).agg(F.sum(F.col("removed") * through).alias("shapley"))
    return rows.join(shares, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
