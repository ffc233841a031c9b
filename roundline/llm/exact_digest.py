"""Canonical exact digest of documents, in DataFrame and SQL functions only.

A text's canonical form has Unicode NFKC normalisation, full case folding, and
runs of white space as one space, none at the ends.  Its digest is 128 bits of two
XXH64; equal buckets are compared byte by byte with their first member.  The
fingerprint is the digest, and for a text that differs from its bucket's first the
digest and 128 bits of the SHA-256 of its canonical bytes.  ``likeness`` of two fingerprints is
1 if they are equal, else 0.

Digests come from a scan of the texts alone.  Order and buckets are made of the
light (id, hash, digest) rows; buckets are counted by partial sums.  The texts
are dealt out once, by (id, hash of text), and that exchange gives the heads of
next documents, the first texts of buckets, and the texts themselves.  A
bucket's first text is dealt to as many slices as the bucket has thousands of
members, so a text with many copies is no hot group.

An edited text is held against the bucket of its digest too: byte by byte where it
is its own document's, by the SHA-256 of the canonical bytes where it is that of
another document or of another edited text.

Null text: empty.  Null id: sorts after all others in descending order.  Rows
that share id and text are one document in the order of documents and have
equal result rows.  One document only: it is its own next.  Empty table: empty
result.  Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import joined_to_one, partitions, scratch, table, text_or_empty, written

#: members of a bucket that one slice of its comparison takes
SLICE_ROWS = 1000
_NULL_ID = -(2**63)


def canonical(text: Column) -> Column:
    """Canonical form; the ICU classes are those that Spark itself comes with."""
    icu = lambda c: F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), icu(text), F.lit(True))
    plain = F.octet_length(text) == F.char_length(text)  # ASCII is its own NFKC form
    folded = F.when(plain, F.lower(text)).otherwise(icu(fold))
    return F.trim(F.regexp_replace(folded, r"[\s\p{Z}\u0085]+", " "))


def with_digest(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the canonical form ``<name>_text`` and the digest ``name`` (hex of 128 bits)."""
    return df.withColumn(f"{name}_text", canonical(F.col(text))).withColumn(name, digest(f"{name}_text"))


def digest(text: str) -> Column:
    """Hex of 128 bits."""
    return F.lower(F.concat(*(F.lpad(F.hex(h), 16, "0") for h in (F.xxhash64(text), F.xxhash64(F.lit("wide"), text)))))


def likeness(a: str, b: str) -> Column:
    return F.when(F.col(a) == F.col(b), 1.0).otherwise(0.0)


def dealt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, tie, text): the documents by id (null: the smallest long) and hash of text."""
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("key"), text_or_empty(text_col).alias("text"))
    return own.select("key", F.xxhash64("text").alias("tie"), "text")


def check(canonical_text: str) -> Column:
    """128 bits of SHA-256, to tell texts of one digest apart."""
    return F.substring(F.unhex(F.sha2(canonical_text, 256)), 1, 16)


def digests(texts: DataFrame) -> DataFrame:
    """(key, tie, n_chars, digest, check) of each document, from a scan."""
    found = with_digest(texts, "text", "digest")
    return found.select("key", "tie", F.char_length("text").cast("long").alias("n_chars"), "digest", check("digest_text").alias("check"))


def next_documents(light: DataFrame, folder: str) -> DataFrame:
    """(key, tie, n_chars, digest, check, next_key, next_tie, next_digest): each
    document's next in descending order of id (the last one's is the first).

    The order is that of range partitions; within each it comes from a window,
    and one row a partition tells where the next one begins."""
    order = [F.col("key").desc(), F.col("tie").desc()]
    ranged = written(light.distinct().repartitionByRange(*order).withColumn("range", F.spark_partition_id()), f"{folder}/order")
    here = F.struct("key", "tie", "digest")
    starts = ranged.groupBy("range").agg(F.max(here).alias("start"))  # the order descends
    of_all = W.orderBy("range")  # as many rows as partitions
    following = starts.select("range", F.coalesce(F.lead("start").over(of_all), F.first("start").over(of_all.rowsBetween(W.unboundedPreceding, 0))).alias("start"))
    inside = ranged.withColumn("next", F.lead(here).over(W.partitionBy("range").orderBy(*order)))
    both = inside.join(following, "range").withColumn("next", F.coalesce("next", "start"))
    return both.select("key", "tie", "n_chars", "digest", "check", F.col("next.key").alias("next_key"), F.col("next.tie").alias("next_tie"), F.col("next.digest").alias("next_digest"))


def first_texts(light: DataFrame, by_key: DataFrame, folder: str) -> DataFrame:
    """(key, tie, first_key, first_text) of the documents in buckets of several
    texts: the canonical text of the bucket's first."""
    one = light.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "tie")).alias("first")).where("n > 1")
    sliced = written(one.select("digest", "n", F.ceil(F.col("n") / SLICE_ROWS).cast("int").alias("slices"), F.col("first.key").alias("first_key"), F.col("first.tie").alias("first_tie")), f"{folder}/buckets")
    wanted = sliced.select(F.col("first_key").alias("key"), F.col("first_tie").alias("tie"), "slices")
    head = by_key.join(wanted, ["key", "tie"]).groupBy("key", "tie", "slices").agg(F.first("text").alias("text"))
    heads = head.select(F.col("key").alias("first_key"), F.col("tie").alias("first_tie"), canonical(F.col("text")).alias("first_text"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    members = joined_to_one(light.select("key", "tie", "digest").distinct(), sliced, "digest").withColumn("slice", F.pmod(F.xxhash64("key", "tie"), "slices").cast("int"))
    return members.join(heads, ["first_key", "first_tie", "slice"]).select("key", "tie", "first_key", "first_text")


def compare_with_edited(texts: DataFrame, folder: str) -> DataFrame:
    """Fingerprints of each text, of its edited form and of the next document, and the
    smallest id with the same canonical bytes."""
    light = written(digests(texts), f"{folder}/light")
    after = written(next_documents(light, folder), f"{folder}/next")
    by_key = texts.repartition(2 * partitions(texts.sparkSession), "key", "tie")
    tail = F.floor(F.col("n_chars") / 3).cast("int")
    to_next = after.select(F.col("key").alias("of_key"), F.col("tie").alias("of_tie"), tail.alias("tail"), F.col("next_key").alias("key"), F.col("next_tie").alias("tie"))
    heads = by_key.join(to_next, ["key", "tie"]).select(F.col("of_key").alias("key"), F.col("of_tie").alias("tie"), F.substring("text", F.lit(1), F.col("tail")).alias("head"))
    # rows that share id and text are alike: any one of their heads will do
    heads = heads.groupBy("key", "tie").agg(F.first("head").alias("head"))
    own = by_key.join(after, ["key", "tie"]).join(heads, ["key", "tie"]).join(first_texts(light, by_key, folder), ["key", "tie"], "left")
    cut = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - tail).cast("int")), "head")
    apart = F.when(F.col("first_text").isNotNull() & (canonical(F.col("text")) != F.col("first_text")), F.lower(F.hex("check")))
    edited = with_digest(own.withColumns({"apart": apart, "edited": cut}), "edited", "edited_digest")
    same_bucket = F.col("edited_digest") == F.col("digest")
    edited_apart = F.when(same_bucket & (F.col("edited_digest_text") != F.coalesce("first_text", canonical(F.col("text")))), F.lower(F.hex(check("edited_digest_text"))))
    rows = edited.select("key", "tie", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "digest", "check", "apart", "edited_digest", check("edited_digest_text").alias("edited_check"), edited_apart.alias("edited_apart"), "next_key", "next_tie", "next_digest", "first_key")
    return _told_apart(written(rows, f"{folder}/rows"), folder)


def _told_apart(rows: DataFrame, folder: str) -> DataFrame:
    """``rows`` with ``fingerprint``, ``edited_fingerprint`` and ``next_fingerprint``.

    Buckets of different texts, edited ones included, are those whose checks differ:
    without any, all fingerprints are the digests."""
    named = lambda digest, apart: F.when(F.col(apart).isNull(), F.col(digest)).otherwise(F.concat_ws("-", digest, apart))
    rows = rows.withColumns({"fingerprint": named("digest", "apart"), "edited_fingerprint": named("edited_digest", "edited_apart"), "next_fingerprint": F.col("next_digest")})
    own = rows.select("digest", "check", F.struct(F.lit(0).alias("edited"), "key", "tie").alias("at"))
    cut = rows.select(F.col("edited_digest").alias("digest"), F.col("edited_check").alias("check"), F.struct(F.lit(1).alias("edited"), "key", "tie").alias("at"))
    sums = own.unionByName(cut).groupBy("digest").agg(F.min_by("check", "at").alias("first"), F.min("check").alias("lo"), F.max("check").alias("hi"))
    mixed = written(sums.where("lo <> hi").select("digest", "first"), f"{folder}/mixed")
    if not mixed.limit(1).count():
        return rows
    to_edited = mixed.select(F.col("digest").alias("edited_digest"), F.col("first").alias("edited_first"))
    other = F.col("edited_first").isNotNull() & (F.col("edited_check") != F.col("edited_first"))
    print_ = F.when(other & F.col("edited_apart").isNull(), F.concat_ws("-", "edited_digest", F.lower(F.hex("edited_check")))).otherwise(F.col("edited_fingerprint"))
    rows = rows.join(to_edited, "edited_digest", "left").withColumn("edited_fingerprint", print_).drop("edited_first")
    # texts told apart have other fingerprints than their digests: the next documents' are looked up
    odd = rows.where("apart is not null").select(F.col("key").alias("next_key"), F.col("tie").alias("next_tie"), F.col("fingerprint").alias("odd")).distinct()
    return rows.join(odd, ["next_key", "next_tie"], "left").withColumn("next_fingerprint", F.coalesce("odd", "next_digest")).drop("odd")


def op4_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their likeness to the edited and the next texts."""
    found = compare_with_edited(dealt(table(spark, sf_dir, "documents")), scratch(spark, "digest"))
    doc_id = F.nullif("key", F.lit(_NULL_ID))
    first = F.when(F.col("apart").isNull(), F.coalesce(F.nullif("first_key", F.lit(_NULL_ID)), doc_id))
    return found.select(doc_id.alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"), first.alias("group_id"))
