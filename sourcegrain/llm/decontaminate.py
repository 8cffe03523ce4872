"""Benchmark decontamination: size-partitioned MinHash containment search, all in DataFrame expressions.

Items are partitioned by the size of their shingle set. Each partition keeps for every item the smallest hashes of its
shingles, as many as the partition's upper size bound allows shingles to be missing, plus one. A document with the
asked containment therefore holds at least one of them, whatever its own length: no item is missed, which banding over
whole-document sketches can't promise for short items in long texts. Candidates are then verified on the shingles
themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcegrain.session import stored

SHINGLE = 5
PERCENT = 80  # containment asked for
BROADCAST_DOCS = 250_000  # candidate documents, with the few items of each, up to which they go to every executor


def words(text: str | Column) -> Column:
    column = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(F.coalesce(column.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _starts(of: str) -> Column:
    """Numbers of the shingles of an item's word array; a shorter item is one shingle, one without words has none."""
    n = F.size(of)
    last = F.greatest(n - SHINGLE, F.lit(0))
    return F.when(n > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _places(of: str, lengths: list[int]) -> Column:
    """Shingles of a document's word array for every one of ``lengths``, each as one number: 8 * place + length."""
    return F.concat(*[F.when(F.size(of) >= n, F.sequence(F.lit(n), (F.size(of) - n) * 8 + n, F.lit(8)))
                      .otherwise(F.array().cast("array<int>")) for n in lengths])


def _place(code: str) -> tuple[Column, Column]:
    """(place, length) of such a number."""
    return F.shiftright(code, 3), F.col(code).bitwiseAND(7)


def _hashed(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def _shingle_hash(hashes: str, at: Column, size: Column) -> Column:
    return F.xxhash64(*[F.when(size > i, F.get(hashes, at + i)) for i in range(SHINGLE)])


def _shingle_text(words_: str, at: Column, size: Column) -> Column:
    return F.array_join(F.slice(words_, at + 1, size), " ")


def item_classes(items: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """(one row per set of shingles: item, copies, n, shingles; membership: item_id, item). Items without words have none."""
    base = items.select(F.col(id_column).alias("item_id"), words(text_column).alias("w")).where("size(w) > 0")
    rows = base.select("item_id", "w", F.explode(_starts("w")).alias("at")).select("item_id", _shingle_text("w", F.col("at"), F.lit(SHINGLE)).alias("s"))
    sets = rows.groupBy("item_id").agg(F.sort_array(F.collect_set("s")).alias("shingles"))  # the shingles of one short item
    classes = sets.groupBy("shingles").agg(F.min("item_id").alias("item"), F.count("*").alias("copies")).withColumn("n", F.size("shingles"))
    members = sets.join(classes.select("shingles", "item"), "shingles").select("item_id", "item")
    return classes, members


def search(docs: DataFrame, items: DataFrame, doc_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """(doc_id, item_id, copies, n_shingles, n_shared, containment) for every document and benchmark item of which at least
    80 percent of the distinct 5-word shingles stand in the document.

    Words are runs of letters and digits in lower case. Items with equal shingle sets are one class, named by the
    smallest id and counted in ``copies``. An item below five words is one shingle, found wherever its words stand one
    after another in a document; null and empty texts have no shingles; rows without id are left out; rows with the same doc_id count as one document; empty tables give no rows.
    """
    classes = stored(item_classes(items.where(F.col(item_column).isNotNull()), item_column, text_column)[0])
    numbered = classes.select("item", "n", F.explode("shingles").alias("s")).withColumn("w", F.split("s", " "))
    padded = F.xxhash64(*[F.when(F.size("w") > i, F.xxhash64(F.get("w", F.lit(i)))) for i in range(SHINGLE)])
    hashed = numbered.select("item", "n", padded.alias("h"))
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double"))))  # the size partition's bound
    keep = upper - F.ceil(upper * PERCENT / 100) + 1
    sketches = (hashed.groupBy("item", "n").agg(F.sort_array(F.collect_list("h")).alias("h"))
                .select("item", F.explode(F.slice("h", F.lit(1), keep.cast("int"))).alias("h")).groupBy("h").agg(F.collect_list("item").alias("found")))
    # documents are cut into the lengths that occur among the items: five words, and at most four shorter ones
    length = F.size(F.split(F.get("shingles", F.lit(0)), " "))
    lengths = sorted(classes.agg(F.collect_set(length).alias("l")).first()["l"]) or [SHINGLE]
    base = docs.where(F.col(doc_column).isNotNull()).select(F.col(doc_column).alias("_doc"), F.col(text_column).alias("_text"))
    hashes = base.select("_doc", _hashed(words("_text")).alias("hs"))
    rows = hashes.select("_doc", "hs", F.explode(_places("hs", lengths)).alias("p")).select("_doc", _shingle_hash("hs", *_place("p")).alias("h"))
    candidates = stored(rows.join(sketches, "h").select("_doc", F.explode("found").alias("item")).distinct())
    wanted = candidates.groupBy("_doc").agg(F.collect_set("item").alias("items"))  # bounded by the words of one document
    if candidates.select("_doc").distinct().count() <= BROADCAST_DOCS:
        wanted = F.broadcast(wanted)  # of checked size; beyond it the texts meet their candidates in a shuffle
    texts = base.join(wanted, "_doc").select("_doc", "items", words("_text").alias("w"))
    held = texts.select("_doc", "items", "w", F.explode(_places("w", lengths)).alias("p")).select(
        "_doc", "items", _shingle_text("w", *_place("p")).alias("s"))
    shared = (held.join(numbered.select("item", "n", "s"), "s").where(F.array_contains("items", F.col("item")))
              .groupBy("_doc", "item", "n").agg(F.count_distinct("s").alias("n_shared")))
    named = shared.where(F.col("n_shared") * 100 >= F.col("n") * PERCENT).join(classes.select("item", "copies"), "item")
    return named.select(F.col("_doc").alias("doc_id"), F.col("item").alias("item_id"), "copies", F.col("n").cast("long").alias("n_shingles"),
                        "n_shared", (F.col("n_shared") / F.col("n")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, doc_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents that hold no benchmark item; rows without id stay."""
    found = search(docs, items, doc_column, "item_id", text_column).select(F.col("doc_id").alias(doc_column)).distinct()
    return docs.join(found, doc_column, "left_anti")
