"""Document fingerprints: an exact digest of the canonical text, in SQL functions alone.

Canonical: Unicode NFKC, full case folding, NFKC again, every run of white space one blank,
none at the ends. The digest is four xxhash64 lanes, 64 hex digits. Equal digests are
only a bucket: texts are one if their canonical bytes are equal too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

LANES = 4
BUCKET = 512  # rows of neighbouring doc_ids that are ordered together


def canonical(text: Column) -> Column:
    """The canonical form; null is as empty. Normalizer and folding are those of the ICU library in Spark."""
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = compose(F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(F.coalesce(text, F.lit(""))), F.lit(True)))
    return F.trim(F.regexp_replace(folded, r"[\s\x{85}\p{Z}]+", " "))


def digest(canon: Column) -> Column:
    return F.concat(*[F.lower(F.lpad(F.hex(F.xxhash64(F.lit(i), canon)), 16, "0")) for i in range(LANES)])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, group_id: the smallest doc_id among documents of equal canonical text.

    Null and empty texts, and those of white space alone, are equal. Buckets of one digest are compared by
    their smallest and largest canonical text, so a group of any size is one partial
    aggregate; a bucket that holds different texts is parted by the texts themselves.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), canonical(F.col(text_col).cast("string")).alias("canon"))
    own = own.select("doc_id", "canon", digest(F.col("canon")).alias("fingerprint"))
    bins = own.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.min("canon").alias("lo"), F.max("canon").alias("hi"))
    bins = bins.select("fingerprint", "least", (F.col("lo") != F.col("hi")).alias("mixed"))
    clashing = own.join(bins.where("mixed").select("fingerprint"), "fingerprint", "left_semi").groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("own_least"))
    clashing = clashing.select(F.col("fingerprint").alias("_f"), F.col("canon").alias("_c"), "own_least")
    out = own.join(bins, "fingerprint").join(clashing, F.col("mixed") & (F.col("fingerprint") == F.col("_f")) & (F.col("canon") == F.col("_c")), "left")
    return out.select("doc_id", "fingerprint", F.when(F.col("mixed"), F.col("own_least")).otherwise(F.col("least")).alias("group_id"))


def _following(keys: DataFrame, width: int = BUCKET) -> DataFrame:
    """(bucket, following): the next larger bucket that occurs; null for the last.

    Neighbours are found in spans of `width` buckets, and between spans by the spans' first
    ones, which are fewer by that factor each time and at the end few enough for one window.
    """
    span = F.floor(F.col("bucket") / width)
    inside = keys.select("bucket", span.alias("span")).withColumn("following", F.lead("bucket").over(Window.partitionBy("span").orderBy("bucket")))
    first = keys.groupBy(span.alias("span")).agg(F.min("bucket").alias("first"))
    wide = first.withColumn("wide", F.floor(F.col("span") / width))
    ahead = wide.withColumn("next_first", F.lead("first").over(Window.partitionBy("wide").orderBy("span")))
    firsts = first.groupBy(F.floor(F.col("span") / width).alias("wide")).agg(F.min("first").alias("wide_first"))
    widest = firsts.select("wide", F.lead("wide_first").over(Window.orderBy("wide")).alias("wide_next"))
    ahead = ahead.join(widest, "wide").select("span", F.coalesce("next_first", "wide_next").alias("next_first"))
    return inside.join(ahead, "span").select("bucket", F.coalesce("following", "next_first").alias("following"))


def _bucketed(own: DataFrame, fan: int = 64) -> DataFrame:
    """own with `bucket`, about BUCKET neighbours by doc_id: equal steps inside each of fan * fan quantiles, so ids
    that lie far off widen the steps of one quantile alone. The tables that say so are bounded: fan * fan rows."""
    shares = [(i + 1) / fan for i in range(fan)]
    ids = own.select("doc_id").where("doc_id is not null")
    cut = lambda c: F.percentile_approx(c, shares, 10_000)
    at = lambda cuts, c: F.size(F.filter(cuts, lambda x: x < c)).cast("long")
    outer = ids.agg(cut("doc_id")).first()[0] or []
    outer = F.array(*[F.lit(x) for x in outer]) if outer else F.array().cast("array<bigint>")
    inner = {r.o: r.cuts for r in ids.groupBy(at(outer, F.col("doc_id")).alias("o")).agg(cut("doc_id").alias("cuts")).collect()}
    cuts = F.create_map(*[x for o, c in sorted(inner.items()) for x in (F.lit(o), F.array(*[F.lit(v) for v in c]))]) if inner else F.create_map().cast("map<bigint,array<bigint>>")
    o = at(outer, F.col("doc_id"))
    part = o * (fan + 1) + at(F.element_at(cuts, o), F.col("doc_id"))
    stats = ids.groupBy(part.alias("part")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    step = F.greatest(F.lit(1.0), (F.col("hi").cast("double") - F.col("lo").cast("double") + 1) / F.col("n") * BUCKET)
    stats = F.broadcast(stats.select(F.col("part").alias("_at"), F.col("lo").cast("double").alias("_lo"), step.alias("_step")))
    nameless = F.lit((fan + 1) ** 2 << 40) + F.pmod(F.xxhash64("text"), F.lit(1024))
    rows = own.withColumn("_part", part).join(stats, F.col("_part") == F.col("_at"), "left")
    bucket = F.col("_part") * F.lit(1 << 40) + F.floor((F.col("doc_id").cast("double") - F.col("_lo")) / F.col("_step")).cast("long")
    return rows.select("doc_id", "text", F.when(F.col("doc_id").isNull(), nameless).otherwise(bucket).alias("bucket"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside that of its edited text and of the next document.

    The edited text has its last floor(n_chars/2) code points replaced by the first as many
    (or all) of the next document by ascending doc_id; after the last comes the first. Null
    texts are empty. Rows of equal doc_id follow each other by text; rows without a doc_id
    come last, in an order of their texts' hashes. A single document follows itself.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    own = _bucketed(own)
    order = [F.col("doc_id").asc_nulls_last(), F.col("text")]
    ahead = Window.partitionBy("bucket").orderBy(*order)
    marked = own.select("doc_id", "text", "bucket", digest(canonical(F.col("text"))).alias("fingerprint"))
    rows = marked.withColumn("next", F.lead(F.struct("text", "fingerprint")).over(ahead))
    # What follows the last row of a bucket: the first of the next that has any; of the last, the very first.
    firsts = own.groupBy("bucket").agg(F.min_by("text", F.struct(F.col("doc_id").isNull(), "doc_id", "text")).alias("text"))
    following = _following(own.select("bucket").distinct())
    start = own.agg(F.min("bucket").alias("start"))
    following = following.crossJoin(F.broadcast(start)).select(F.col("bucket").alias("_bucket"), F.coalesce("following", "start").alias("following"))  # one row
    edges = firsts.join(following, firsts.bucket == following.following).select("_bucket", F.struct("text", digest(canonical(F.col("text"))).alias("fingerprint")).alias("edge"))
    rows = rows.join(edges, rows.bucket == edges._bucket, "left").select("doc_id", "text", "fingerprint", F.coalesce("next", "edge").alias("next"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.col("next.text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    rows = rows.withColumn("canon_edited", canonical(F.col("edited")))
    rows = rows.withColumn("edited_fingerprint", digest(F.col("canon_edited")))
    # Bytes are compared inside equal buckets alone.
    same = F.when(F.col("fingerprint") == F.col("edited_fingerprint"), canonical(F.col("text")) == F.col("canon_edited")).otherwise(F.lit(False))
    near = F.when(F.col("fingerprint") == F.col("next.fingerprint"), canonical(F.col("text")) == canonical(F.col("next.text"))).otherwise(F.lit(False))
    return rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", same.cast("double").alias("near_edited"), near.cast("double").alias("near_next"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))
