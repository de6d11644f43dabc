"""Benchmark decontamination: which documents hold which test items, by DataFrame functions only.

The items are partitioned by the size of their shingle sets (powers of two). An item's MinHash sketch holds the k
smallest hashes of its set, k depending on the partition's upper bound u: twice the shingles that an item of that size may miss, and SPARE
more. The share of the sketch that a document holds estimates the containment; the containment asked for is converted to a number of
sketch hashes, k less what an item of this size may miss, so that no match is lost, however long the document. (Sketching the long
side instead loses short items: a 20-shingle item in a document of 10,000 shingles has a Jaccard similarity of 0.002.)
Documents stream their shingles past the sketches; each candidate is verified by the exact share of the item's
shingles that the document holds.

Words are lower-cased runs without white space or ASCII punctuation. An item of fewer words than a shingle is one shingle of all of
them, which a document holds if it has those words side by side. Nulls and edge cases: null or empty texts and items without words
match nothing; rows with equal ids count as one document or item, of all their texts; a null id takes no part; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import Scratch, small

#: Sketch hashes beyond twice the shingles that may be missing.
SPARE = 4


def shingle_hashes(text: Column, sizes: list[int], all_of_short: bool = False) -> Column:
    """Array of the hashes of each run of so many words, for each of the sizes; none where there are fewer words. all_of_short: fewer words
    than sizes[0] are one run of all."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+"), "")
    hashed = F.transform(found, lambda w: F.xxhash64(w))
    none = F.array().cast("array<bigint>")

    def runs(h: Column, size: int) -> Column:
        return F.when(F.size(h) >= size, F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(size))))).otherwise(none)

    def every(h: Column) -> Column:
        if not all_of_short:
            return F.concat(*(runs(h, n) for n in sizes)) if len(sizes) > 1 else runs(h, sizes[0])
        out = runs(h, sizes[0])
        for n in range(1, sizes[0]):
            out = F.when(F.size(h) == n, F.array(F.xxhash64(*(F.get(h, F.lit(j)) for j in range(n))))).otherwise(out)
        return out

    # The one-element array binds the words once; the inner lambdas then refer to them as a variable.
    return F.get(F.transform(F.array(hashed), every), F.lit(0))


def _word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\s\p{Punct}]+"), ""))


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, containment: tuple[int, int] = (4, 5)) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared, containment): each document and item with at least that share of
    the item's shingles in the document."""
    num, den = containment
    scratch = Scratch(docs.sparkSession, "decontaminate")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    tests = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text")).where("item_id is not null")
    own = scratch.table(tests.select("item_id", F.explode(shingle_hashes(F.col("text"), [shingle], True)).alias("shingle")).distinct(), "items")
    short = tests.select(_word_count(F.col("text")).alias("n")).where((F.col("n") > 0) & (F.col("n") < shingle)).distinct()
    sizes = [shingle, *sorted(r.n for r in short.collect())]  # `shingle` numbers at most
    # An item's set is as small as the item; the sets of a whole benchmark are never in one row.
    sized = own.groupBy("item_id").agg(F.sort_array(F.collect_list("shingle")).alias("all")).withColumn("q", F.size("all"))
    missing = lambda n: F.floor(n * (den - num) / den).cast("int")
    upper = F.pow(F.lit(2), F.ceil(F.log2("q"))).cast("int")
    cut = sized.withColumn("k", F.least(F.col("q"), 2 * missing(upper) + SPARE)).withColumn("need", F.col("k") - missing(F.col("q")))
    sketch = scratch.table(cut.select("item_id", "q", "need", F.explode(F.slice("all", F.lit(1), F.col("k"))).alias("shingle")), "sketch")

    stream = texts.select("doc_id", F.explode(shingle_hashes(F.col("text"), sizes)).alias("shingle"))
    hits = stream.join(small(sketch.select("item_id", "need", "shingle")), "shingle").groupBy("doc_id", "item_id", "need").agg(F.countDistinct("shingle").alias("hits"))
    pairs = scratch.table(hits.where("hits >= need").select("doc_id", "item_id"), "pairs")
    again = texts.join(scratch.small(pairs.select("doc_id").distinct(), "hit"), "doc_id", "left_semi")
    held = again.select("doc_id", F.explode(F.array_distinct(shingle_hashes(F.col("text"), sizes))).alias("shingle"))
    shared = held.join(small(own), "shingle").groupBy("doc_id", "item_id").agg(F.countDistinct("shingle").alias("shared"))
    sure = shared.join(pairs, ["doc_id", "item_id"], "left_semi").join(scratch.small(sketch.select("item_id", "q").distinct(), "sizes"), "item_id")
    return sure.where(F.col("shared") * den >= F.col("q") * num).select("doc_id", "item_id", F.col("q").cast("long").alias("item_shingles"), "shared", (F.col("shared") / F.col("q")).alias("containment"))


#: The same result by brute force, in DuckDB's SQL.
ORACLE_SQL = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[\s[:punct:]]+'), lambda x: x <> '') as w from documents where doc_id is not null and text is not null),
i as (select item_id, list_filter(regexp_split_to_array(lower(text), '[\s[:punct:]]+'), lambda x: x <> '') as w from benchmark where item_id is not null and text is not null),
k as (select item_id, w, least(5, len(w)) as k from i where len(w) > 0),
its as (select distinct item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as s from k),
ds as (select distinct doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as s from d, (select distinct k from k) where len(w) >= k),
q as (select item_id, count(*) as q from its group by item_id),
m as (select doc_id, item_id, count(*) as shared from ds join its using (k, s) group by doc_id, item_id)
select doc_id, item_id, q as item_shingles, shared, shared / q as containment from m join q using (item_id) where shared * 5 >= q * 4
"""
