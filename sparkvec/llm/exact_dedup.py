"""Exact duplicates by progressive refinement: length, then a hash of the prefix, then the full hash.

Native: DataFrame functions only. Full content is hashed only for rows whose length and prefix
another row shares. Texts never move; what is shuffled are ids, lengths and hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store, text_of

PREFIX_CHARS = 64
# Keys (length and prefix hash) that are broadcast at most; a key takes about 64 bytes in a hash table.
BROADCAST_KEYS = 1_000_000


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Groups of identical texts.

    Returns one row per input row: `id_col`, keep_id (the group's largest id), group_size, kept, copies
    (rows with this group's keep_id: over 1 only if a row is repeated) and, with `digest`,
    text_sha256. Null texts are empty texts. Rows that repeat an id and a text share its fate; a null
    id is below all others and stays only in a group without any id. Other columns aren't read. An
    empty table gives an empty result. The full hash decides; two texts with one length and one
    SHA-256 count as identical.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).select("_id", text_of("_text").alias("_text"))
    rows = rows.select("_id", "_text", F.octet_length("_text").alias("_len"),
                       F.xxhash64(F.substring("_text", 1, PREFIX_CHARS)).alias("_prefix"))
    slim = store(rows.select("_len", "_prefix"), "lengths")
    lengths = store(slim.groupBy("_len").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_len"), "shared-lengths")
    fits = lengths.count() <= BROADCAST_KEYS  # lengths are few; beyond the bound both sides are shuffled
    keys = (slim.join(F.broadcast(lengths) if fits else lengths, "_len", "left_semi").groupBy("_len", "_prefix")
            .agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_len", "_prefix", F.lit(True).alias("_hit")))
    keys = store(keys, "prefixes")
    full = F.sha2("_text", 256)
    if keys.count() <= BROADCAST_KEYS:
        found = rows.join(F.broadcast(keys), ["_len", "_prefix"], "left")
        found = found.select("_id", "_len", "_hit", (full if digest else F.when(F.col("_hit"), full)).alias("_hash"))
    else:  # too many shared prefixes for a broadcast: hash in the scan, so that texts stay where they are
        found = rows.select("_id", "_len", "_prefix", full.alias("_hash")).join(keys, ["_len", "_prefix"], "left")
    found = store(found.select("_id", "_len", "_hit", "_hash"), "hashes")
    groups = store(found.where("_hit").groupBy("_len", "_hash", "_id").agg(F.count(F.lit(1)).alias("c"))
                   .groupBy("_len", "_hash").agg(F.sum("c").alias("_size"), F.max(F.struct("_id", "c")).alias("_top"))
                   .where("_size > 1"), "groups")  # stored, so that the join below can split a hot group
    single = F.col("_size").isNull()
    keep = F.when(single, F.col("_id")).otherwise(F.col("_top._id"))
    out = (found.join(groups, ["_len", "_hash"], "left")
           .select(F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
                   F.col("_id").eqNullSafe(keep).alias("kept"), F.coalesce("_top.c", F.lit(1)).cast("long").alias("copies"),
                   F.col("_hash").alias("text_sha256")))
    return out if digest else out.drop("text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one per distinct text, with all their columns.

    Ids should name one text each; if one id names several texts, each text is judged by itself. Dropped ids
    are few, so they are taken away by an anti join; only texts of repeated ids are shuffled when the
    dropped ids fit a broadcast.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("_row")  # keeps the columns' names apart from ours
    hashed = docs.select(row, docs[id_col].alias("_id"), F.sha2(F.coalesce(docs[text_col], F.lit("")), 256).alias("_text_hash"))
    groups = exact_groups(docs, id_col, text_col, digest=True)
    marks = groups.where("not kept or copies > 1").select(
        F.col(id_col).alias("_mark_id"), F.col("text_sha256").alias("_mark_hash"), "kept", "copies").distinct()
    marks = store(marks, "marks")
    same = hashed["_id"].eqNullSafe(marks["_mark_id"]) & (hashed["_text_hash"] == marks["_mark_hash"])
    fits = marks.count() <= BROADCAST_KEYS
    joined = hashed.join(F.broadcast(marks) if fits else marks, same, "left").where("kept is null or kept")
    once = joined.where("copies is null").select("_row.*")
    if marks.where("kept and copies > 1").isEmpty():
        return once
    repeated = joined.where("copies is not null").dropDuplicates(["_mark_id", "_text_hash"])
    return once.unionByName(repeated.select("_row.*"))
