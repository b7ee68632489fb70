"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A benchmark item is contained in a document if at least ``threshold`` of the item's distinct word shingles occur in it.
The MinHash sketch of an item of n shingles holds its ``n - ceil(threshold * n) + 1`` least hashes: a document that
contains the item lacks too few shingles to lack them all, so one shared sketch hash finds every such document, however
long. Both sides are partitioned by size (the power of two of the shingle count). Items of a size class can only be
contained in documents of at least about that size, and the greatest sketch hash of those items bounds the hashes that
such documents need to look up at all. What is found is then verified on the shingles themselves.

Everything here is DataFrame functions. Text is folded by ``lower`` and cut at ASCII white space; a shingle is five words
joined by spaces. An item of fewer words is one shingle, of all its words, and documents are searched for runs of that many.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
THRESHOLD = 0.8
#: Sketch rows up to which they are broadcast (16 bytes each, so 16 MB at most); beyond, they are shuffled.
BROADCAST_ROWS = 1_000_000


def words(text: str = "text") -> Column:
    return F.filter(F.split(F.lower(F.col(text)), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def shingle_strings(w: str, size: Column | int = SHINGLE) -> Column:
    """The distinct shingles of an array of words."""
    size = F.lit(size) if isinstance(size, int) else size
    starts = F.when(F.size(w) >= size, F.sequence(F.lit(0), F.size(w) - size)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(F.col(w), i + 1, size), " ")))


def word_hashes(w: str | Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def shingle_hashes(h: str, size: int = SHINGLE) -> Column:
    """A hash of each shingle, in order: of the hashes of its words, so that no shingle is built as a string."""
    starts = F.when(F.size(h) >= size, F.sequence(F.lit(0), F.size(h) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(F.col(h), i + k) for k in range(size))))


def item_hashes(h: str) -> Column:
    """The shingle hashes of an item; one of fewer words than a shingle is one, of all of them."""
    found = shingle_hashes(h)
    for k in range(1, SHINGLE):
        found = F.when(F.size(h) == k, shingle_hashes(h, k)).otherwise(found)
    return F.array_distinct(found)


def size_class(n: Column) -> Column:
    return F.floor(F.log2(n.cast("double"))).cast("int")


def needed(n: Column, threshold: float) -> Column:
    """The least number of an item's n shingles that a document must hold; the margin absorbs floating point."""
    return F.ceil(F.lit(threshold) * n - F.lit(1e-9)).cast("int")


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item, containment) of each item that is contained in a document.

    Null texts, texts without words and rows without an id take no part; of rows that repeat an id each is looked at, and
    the best containment is returned. Items of fewer words than a shingle have one, of all their words, and a document
    holds it if those words stand in a row in it. Documents of any length are searched whole, empty tables give an empty
    result. Other columns are ignored.
    """
    item = items.filter("item_id IS NOT NULL").select("item_id", words().alias("w")).filter(F.size("w") > 0)
    item = item.withColumns({"size": F.least(F.size("w"), F.lit(SHINGLE)), "h": word_hashes("w")}).withColumns({"shingles": shingle_strings("w", F.col("size")), "hashes": item_hashes("h")})
    item = common.staged(item.select("item_id", "size", "shingles", "hashes", F.size("hashes").alias("n")), "items")
    sketch = item.select("item_id", "size", size_class(F.col("n")).alias("item_class"), needed(F.col("n"), threshold).alias("need"), F.explode(F.slice(F.array_sort("hashes"), 1, F.col("n") - needed(F.col("n"), threshold) + 1)).alias("h"))
    sketch = common.staged(sketch, "sketches")
    # One row a size class: the least shingle count that a document needs, and the hashes that it must look up.
    bounds = sketch.groupBy("size", "item_class").agg(F.min("need").alias("need"), F.max("h").alias("bound")).orderBy("size", "item_class").collect()
    hashed = docs.filter("doc_id IS NOT NULL").select("doc_id", word_hashes(words()).alias("w")).select("doc_id", F.size("w").alias("n_words"), "w")
    looked = []
    for size in sorted({row["size"] for row in bounds}):
        limit, covered = F.lit(None).cast("long"), None
        for row in bounds:  # a document of at least ``need`` shingles may hold items of this class and of those below it
            if row["size"] == size:
                covered = row["bound"] if covered is None else max(covered, row["bound"])
                limit = F.when(F.col("n_words") >= row["need"] + size - 1, F.lit(covered)).otherwise(limit)
        asks = hashed.withColumn("limit", limit).filter("limit IS NOT NULL").select("doc_id", "limit", F.explode(shingle_hashes("w", size)).alias("h"))
        looked.append(asks.filter("h <= limit").select("doc_id", "h"))
    if not looked:
        looked = [hashed.select("doc_id", F.lit(0).cast("long").alias("h")).limit(0)]
    side = sketch.select("item_id", "h")
    found = functools.reduce(DataFrame.union, looked).join(F.broadcast(side) if sketch.count() <= BROADCAST_ROWS else side, "h").select("doc_id", "item_id").distinct()
    found = common.staged(found, "candidates")
    # A document with all the items it may hold: as many rows as such documents.
    asked = found.join(item.select("item_id", "size", "shingles"), "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "size", "shingles")).alias("items"))
    texts, few = docs.select("doc_id", "text"), found.select("doc_id").distinct()
    if few.count() <= BROADCAST_ROWS:  # so that the texts of all other documents need not be shuffled
        texts = texts.join(F.broadcast(few), "doc_id", "left_semi")
    held = texts.join(asked, "doc_id").select("doc_id", "items", words().alias("w")).select("doc_id", "items", shingle_strings("w").alias("held"), F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" ")).alias("line"))

    def shared(x: Column) -> Column:
        in_a_row = F.contains(F.col("line"), F.concat(F.lit(" "), F.get(x["shingles"], 0), F.lit(" "))).cast("int")
        return F.when(x["size"] < SHINGLE, in_a_row).otherwise(F.size(F.array_intersect(x["shingles"], F.col("held"))))

    scored = held.select("doc_id", F.explode(F.transform("items", lambda x: F.struct(x["item_id"].alias("item_id"), shared(x).alias("n_shared"), F.size(x["shingles"]).alias("n_item")))).alias("x")).select("doc_id", "x.*")
    scored = scored.filter(F.col("n_shared") >= needed(F.col("n_item"), threshold)).withColumn("containment", F.col("n_shared") / F.col("n_item"))
    return scored.groupBy("doc_id", "item_id").agg(F.max("n_shared").cast("long").alias("n_shared"), F.max("n_item").cast("long").alias("n_item"), F.max("containment").alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, in which no item is contained; rows without doc_id or text stay, and of rows that
    repeat a doc_id all go if one holds an item. Columns may have any names."""
    return docs.join(contained(docs, items).select("doc_id").distinct(), "doc_id", "left_anti").select(common.columns_of(docs))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that contains a benchmark item, with the item."""
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).withColumn("containment", F.round("containment", 9))


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
     ds AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM dw)),
     iw AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
     its AS (SELECT DISTINCT item_id, s FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM iw)),
     n AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY item_id),
     short AS (SELECT DISTINCT item_id, ' ' || array_to_string(w, ' ') || ' ' AS s FROM iw WHERE len(w) BETWEEN 1 AND 4)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_item) AS n_item, round(count(*) / any_value(n_item), 9) AS containment
FROM ds JOIN its USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id
HAVING count(*) >= ceil(0.8 * any_value(n_item) - 1e-9)
UNION ALL
SELECT DISTINCT doc_id, item_id, 1 AS n_shared, 1 AS n_item, 1.0::DOUBLE AS containment
FROM dw JOIN short ON contains(' ' || array_to_string(dw.w, ' ') || ' ', s)
"""
