"""Document fingerprints: bottom-k sketches of shingle hashes, in DataFrame expressions only.

A sketch is the K least distinct 64-bit hashes of a text's shingles (SHINGLE words in a row; all words
if there are fewer), in ascending order. The sketch of a text in parts is the K least of the parts'
sketches together, so sketches merge across parts, partitions and documents; they estimate
resemblance, containment and the number of distinct shingles.

Defined results: a text without words (null, too) has an empty sketch; two empty sketches are alike
(1.0), an empty and a full one are not (0.0). Equal texts have equal sketches. Rows with the same doc_id follow
one another by text. A null doc_id comes first. Columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

K = 128
SHINGLE = 5
WORD_GAPS = r"[\x20\x09-\x0D]+"


# ---- sketches -------------------------------------------------------------------------------


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The bottom-k sketch of a text."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAPS, -1), lambda w: w != "")
    return F.transform(F.array(words), lambda w: _least(_hashes(w, shingle), k))[0]


def _hashes(words: Column, shingle: int) -> Column:
    n = F.size(words)
    starts = F.when(n >= shingle, F.sequence(F.lit(1), F.greatest(n - shingle + 1, F.lit(1)))).when(n > 0, F.array(F.lit(1))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, F.lit(shingle))))


def _least(hashes: Column, k: int) -> Column:
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def merge_all(df: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch per group of rows. Equal hashes of a partition fold before the first shuffle, which spreads a group over tasks; the second moves k hashes a task at most."""
    w = Window.partitionBy(*keys).orderBy("_hash")
    hashes = df.select(*keys, F.explode(column).alias("_hash")).groupBy(*keys, "_hash").agg(F.lit(1).alias("_one"))
    least = hashes.withColumn("_nth", F.row_number().over(w)).filter(F.col("_nth") <= k)
    return least.groupBy(*keys).agg(F.array_sort(F.collect_list("_hash")).alias(column))


def _unit(h: Column) -> Column:
    """A signed hash as a share of the hash range."""
    return (h.cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, (k - 1) / share of the range below the k-th least hash else."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(k - 1.0) / _unit(F.element_at(a, -1)))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's sketch that both hold."""
    both = F.size(F.array_intersect(merge(a, b, k), F.array_intersect(a, b)))
    total = F.least(F.size(F.array_union(a, b)), F.lit(k))
    return F.when(a == b, F.lit(1.0)).when(total == 0, F.lit(1.0)).otherwise(both / total)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds, from the resemblance and the sizes."""
    r, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), r * (n + m) / ((F.lit(1.0) + r) * n)))


def as_text(a: Column) -> Column:
    """A sketch as hex, 16 digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


# ---- neighbours by id -----------------------------------------------------------------------


def with_next(docs: DataFrame, columns: list[Column]) -> DataFrame:
    """Each (doc_id, text) with these columns of its own and ``next``, a struct (text, the columns) of the next by doc_id; the last is followed by the first.

    Rows are cut into ranges of doc_id at quantiles, as many as shuffle partitions; rows of a range
    stand in one task, in order, and what follows the last of a range is the head of the next range, of which
    there is one row a range.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    cuts = known.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    bounds = F.array(*[F.lit(x) for x in sorted(set(cuts))]) if cuts else F.expr("cast(array() as array<bigint>)")
    reach = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda x: x <= F.col("doc_id"))))
    dealt = known.withColumn("range", reach).repartition(n, "range").select("range", "doc_id", "text", *columns)
    names = [c for c in dealt.columns if c not in ("range", "doc_id")]
    order = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    own = dealt.withColumn("next", F.lead(F.struct(*names)).over(order)).withColumn("last", F.lead(F.lit(1)).over(order).isNull())
    heads = known.withColumn("range", reach).groupBy("range").agg(F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(-(2**63))).alias("doc_id"), "text")).alias("head"))
    heads = heads.select("range", F.col("head.text").alias("text")).select("range", F.struct("text", *columns).alias("head"))
    ring = Window.orderBy("range")  # over one row a range, as many as there are shuffle partitions
    follow = heads.select("range", F.coalesce(F.lead("head").over(ring), F.first("head").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("follow"))
    found = own.join(follow, "range", "left")  # own is dealt by range already
    return found.withColumn("next", F.when(F.col("last"), F.col("follow")).otherwise(F.col("next"))).drop("range", "last", "follow")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's sketch, that of its edited text, and how alike it is to the edited text and to the next document.

    The edited text has the last quarter of its code points replaced by the first as many of the next document.
    """
    found = with_next(docs, [sketch(F.col("text")).alias("sketch")])
    n = F.length(F.coalesce("text", F.lit("")))
    quarter = F.floor(n / 4).cast("int")
    after = F.coalesce(F.col("next.text"), F.lit(""))
    edited = F.concat(F.substring(F.coalesce("text", F.lit("")), F.lit(1), n - quarter), F.substring(after, F.lit(1), quarter))
    found = found.select("doc_id", n.cast("long").alias("n_chars"), "sketch", F.col("next.sketch").alias("next_sketch"), edited.alias("edited"))
    found = found.withColumn("edited_sketch", sketch(F.col("edited")))
    return found.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        distinct_shingles(F.col("sketch")).alias("n_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("edited_holds"),
    )
