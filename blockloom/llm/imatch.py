"""I-Match document fingerprints, with DataFrame functions only.

The lexicon holds the terms (lower-cased words) whose document frequency lies between
N / ``RARE`` and N / ``FREQUENT``, a band of the inverse document frequency. It has at most
RARE times the mean number of distinct terms of a document, whatever N is; it is broadcast
when a count shows it within ``BROADCAST_TERMS`` and joined by shuffle otherwise. A
document's distinct terms in the lexicon are sorted and hashed, for the whole lexicon and
for randomised subsets of it: 16 seeds at each of 3 rates. The subsets of a term are bits of a mask
that the lexicon holds, so they are drawn once a term and not once a document. Small rates survive edits of long
documents, large ones describe short documents. The fingerprint joins those hashes as
hexadecimal; a subset without terms of the document is "-". The likeness of two
fingerprints is the share of equal hashes among the subsets that either document has terms
in. A document without any term in the band is hashed over all its terms, so short texts
are told apart.

Defined results: a null text is an empty one; texts without words have the fingerprint of
no terms, equal to each other (likeness 1) and like nothing else (0); equal texts have equal
fingerprints; rows with a null doc_id come last in descending order; rows of one doc_id are
ordered by text, so repeated rows are interchangeable; empty tables give no rows; other
columns are ignored. A single document is its own next one.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, range_bounds, range_bucket, table, text_or_empty, words

RARE, FREQUENT = 2000, 10
SUBSETS = [(0, 1)] + [(seed, rate) for rate in (32, 128, 512) for seed in range(1, 17)]
BROADCAST_TERMS = 4_000_000
#: Documents of a range, and ranges at most: beyond that they grow, and are sorted outside of memory.
ROWS_PER_RANGE, RANGES = 1000, 32768


def terms(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def lexicon(docs: DataFrame, rare: int = RARE, frequent: int = FREQUENT) -> DataFrame:
    """(term, mask): 64-bit hashes of the terms in the band, from the frequencies over all documents, and bits of the subsets after the first that hold them."""
    n = docs.count()
    counts = docs.select(F.explode(terms(text_or_empty())).alias("t")).groupBy(F.xxhash64("t").alias("term")).agg(F.count(F.lit(1)).alias("df"))
    band = counts.where((F.col("df") >= max(2, n / rare)) & (F.col("df") <= max(2, n / frequent)))
    drawn = lambda i, seed, rate: F.when(F.pmod(F.xxhash64("term", F.lit(seed)), F.lit(rate)) == 0, 1 << i).otherwise(0).cast("long")
    return band.select("term", sum((drawn(i, *x) for i, x in enumerate(SUBSETS[1:])), F.lit(0).cast("long")).alias("mask"))


def short(*columns: Column) -> Column:
    return F.shiftright(F.xxhash64(*columns), 32).cast("int")


def once(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def subset_hashes(kept: Column, all_terms: Column) -> Column:
    """Array of one hash for each subset, null without terms. kept: sorted distinct (term, mask) in the lexicon; all_terms: hash of all, null for none."""
    none = F.lit(None).cast("int")
    bits = F.array(*[F.lit(1 << i).cast("long") for i in range(len(SUBSETS) - 1)])
    members = lambda some, bit: F.filter(some, lambda t: t["mask"].bitwiseAND(bit) != 0)
    drawn = once(F.filter(kept, lambda t: t["mask"] != 0), lambda some: F.transform(bits, lambda bit: once(members(some, bit), lambda m: F.when(F.size(m) > 0, short(m)))))
    return F.when(F.size(kept) > 0, F.concat(F.array(short(kept)), drawn)).otherwise(F.array(all_terms, *[none] * (len(SUBSETS) - 1)))


def fingerprint(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.coalesce(F.lower(F.lpad(F.hex(h.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), F.lit("-"))), ":")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets that either has terms in; 1 for two of no terms."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), None).otherwise(F.coalesce((x == y), F.lit(False))))
    known = F.size(F.filter(pairs, lambda p: p.isNotNull()))
    same = F.size(F.filter(pairs, lambda p: p))
    return F.when(known == 0, F.lit(1.0)).otherwise(same / known).cast("double")


def with_next(docs: DataFrame) -> DataFrame:
    """(range, rn, ghost, doc_id, text, next_text) of (doc_id, text); next: by descending doc_id, after the last the first.

    Documents are dealt by ranges of doc_id; the first document of each range is also put, as a
    ghost, at the end of the range before it, so that no window spans the table.
    """
    bounds = range_bounds(docs, "doc_id", max(1, min(RANGES, docs.count() // ROWS_PER_RANGE)))
    dealt = docs.select("doc_id", text_or_empty().alias("text"), range_bucket("doc_id", bounds).alias("range"), F.lit(0).alias("ghost"))
    heads = dealt.groupBy("range").agg(F.max("doc_id").alias("head"))
    up = Window.orderBy("range")
    to = F.coalesce(F.lead("range").over(up), F.min("range").over(Window.partitionBy()), F.lit(0))
    heads = heads.select(F.col("range").alias("r"), "head", to.alias("to"))
    first = dealt.join(F.broadcast(heads), (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("head")))
    first = first.groupBy("to", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", F.col("to").alias("range"), F.lit(1).alias("ghost"))
    order = Window.partitionBy("range").orderBy("ghost", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.unionByName(first).select(
        "range", F.row_number().over(order).alias("rn"), "ghost", "doc_id", "text", F.lead("text").over(order).alias("next_text")
    )


@contextlib.contextmanager
def partitioned_by_part_of_keys(spark: SparkSession):
    """Rows dealt by range are already together for a join on (range, rn): no exchange is wanted for it."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of documents (doc_id, text), of their edited texts, and likenesses (see op6_imatch)."""
    kept_terms = materialise(lexicon(docs))
    if kept_terms.count() <= BROADCAST_TERMS:
        kept_terms = F.broadcast(kept_terms)
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    rows = rows.withColumn("edited", F.when(F.col("ghost") == 0, edited).otherwise(""))
    tagged = lambda c, tag: F.transform(terms(F.col(c)), lambda t: F.struct(F.lit(tag).alias("of"), F.xxhash64(t).alias("term")))
    each = rows.select("range", "rn", F.explode(F.concat(tagged("text", 0), tagged("edited", 1))).alias("x")).select("range", "rn", "x.of", "x.term")
    sets = each.join(kept_terms, "term").groupBy("range", "rn").agg(
        F.sort_array(F.collect_list(F.when(F.col("of") == 0, F.struct("term", "mask")))).alias("own"),
        F.sort_array(F.collect_list(F.when(F.col("of") == 1, F.struct("term", "mask")))).alias("changed"),
    )
    facts = rows.select("range", "rn", "ghost", "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), *[
        once(terms(F.col(c)), lambda t: F.when(F.size(t) > 0, short(F.sort_array(t), F.lit("all")))).alias(f"all_{c}") for c in ("text", "edited")
    ])
    none = F.array().cast("array<struct<term:bigint,mask:bigint>>")
    both = facts.join(sets, ["range", "rn"], "left").select(
        *("range", "rn", "ghost", "doc_id", "n_chars", "edited_sha256"),
        subset_hashes(F.coalesce("own", none), F.col("all_text")).alias("fp"),
        subset_hashes(F.coalesce("changed", none), F.col("all_edited")).alias("efp"),
    )
    following = F.lead("fp").over(Window.partitionBy("range").orderBy("rn"))
    with partitioned_by_part_of_keys(docs.sparkSession):
        done = materialise(both.withColumn("next_fp", following).where("ghost = 0").drop("range", "rn", "ghost"))
    return done.select(
        *("doc_id", "n_chars", "edited_sha256"),
        fingerprint(F.col("fp")).alias("fingerprint"),
        fingerprint(F.col("efp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("efp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )


def op6_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
