"""Exact dedup by an extendible-hash index on shared files.

Texts are equal if they are identical after A-Z are lower-cased; null counts as empty. Of equal texts the row with the largest doc_id stays.

The pseudo-key of a text is 63 bits of its hash. The directory begins with as many slots as buckets of ``capacity`` keys would fill; each bucket that holds more is split by the
next bit, which doubles the directory, until all fit or the histogram's bits end (a bucket beyond that keeps its overflow). Slots are leading bits, so a bucket is a range of keys,
and an owner task sorts and writes a range of buckets: the index's files hold an entry for each distinct text, chained where several texts have one key.

Bytes decide. A key that one row has needs no comparison. For the others the texts themselves are grouped by Spark: each task sends one row for each text that it holds,
however many copies it has met, so that a group of copies that has a third of all rows meets as one row a task. The texts of a key are chained in order of their digest.
Rows then find their entry by (key, digest), which is exact because the digests of a chain have been compared with its texts: two texts with one digest stop the job.

Only functions of DataFrames run here: no Python workers. The keys of copies are broadcast up to BROADCAST of them (8 bytes each), so that only the texts of copies are shuffled; beyond that
all distinct texts are. Rows of a key with over a million copies are dealt over all partitions when they look up their entry.

Nulls and edge cases: null and empty texts are one group; texts of any length are compared whole; rows with a null doc_id take no part; rows that are repeated (doc_id and text) count each,
and where their doc_id is the one that stays, all of them are kept, as nothing tells them apart; extra columns stay away, whatever their names are. An empty table gives no rows and an
empty directory."""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import lookup, partitions, table

#: Bits of a pseudo-key; bits beyond the first directory that its histogram has; keys of copies that are broadcast at most.
BITS, FINER, BROADCAST = 63, 3, 1 << 20


@dataclass
class Index:
    """``rows``: doc_id, key, digest of every document. ``directory``: depth, prefix (the depth leading bits), entries. ``entries``: bucket (the least key of its
    bucket), key, chain (place among the texts of the key, from 0), digest, keep_id, group_size; its files are in order of (bucket, key, chain). ``most``: the largest group_size."""

    rows: DataFrame
    directory: DataFrame
    entries: DataFrame
    most: int


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def pseudo_key(text: Column, bits: int = BITS) -> Column:
    """The hash's leading bits, at the top of BITS bits (so that ranges of keys are the same for any number of bits)."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - bits), BITS - bits)


def _leading(key: str, bits: Column | int, of: int = BITS) -> Column:
    """The leading bits of an unsigned number of ``of`` bits."""
    return F.call_function("shiftright", F.col(key), F.lit(of) - bits)


def _directory(keys: DataFrame, capacity: int, bits: int) -> tuple[DataFrame, int]:
    """depth, prefix, entries of each bucket, and the largest depth, for the keys of all entries. The state after all splits doesn't depend on the order of insertion,
    so the rounds of doubling run over a histogram of the keys' leading bits."""
    total = keys.count()
    first = min(bits, max(0, math.ceil(math.log2(max(1, total) / capacity))))
    last = min(bits, first + FINER)
    level = keys.groupBy(_leading("key", last).alias("slot")).agg(F.count("*").alias("n"))
    level = table(level, "slots")
    done = None
    for depth in range(first, last + 1):  # a round: buckets that fit are settled, the others are split by one more bit
        whole = level.groupBy(_leading("slot", depth, last).alias("prefix")).agg(F.sum("n").alias("entries"))
        fits = whole if depth == last else whole.where(F.col("entries") <= capacity)
        settled = fits.select(F.lit(depth).alias("depth"), "prefix", "entries")
        done = settled if done is None else done.unionByName(settled)
        if depth < last:
            level = level.join(whole.where(F.col("entries") > capacity).select(F.col("prefix").alias("over")), _leading("slot", depth, last) == F.col("over"), "left_semi")
    return table(done, "directory"), last


def _addressed(entries: DataFrame, directory: DataFrame, last: int) -> DataFrame:
    """Entries with the bucket of their key: the directory has a slot for each of the last bits, several of which lead to one bucket."""
    widened = lambda prefix, bits: F.call_function("shiftleft", prefix, bits - F.col("depth"))
    first, end = (widened(p, F.lit(last)) for p in (F.col("prefix"), F.col("prefix") + 1))
    slots = directory.select(F.explode(F.sequence(first, end - 1)).alias("slot"), widened(F.col("prefix"), F.lit(BITS)).alias("bucket"))
    return entries.withColumn("slot", _leading("key", last)).join(slots, "slot").drop("slot")


def build(docs: DataFrame, capacity: int = 1 << 16, bits: int = BITS) -> Index:
    """The index of the documents. ``bits``: how many bits a pseudo-key has; few make chains long."""
    if capacity < 1 or not 1 <= bits <= BITS:
        raise ValueError(f"a bucket holds a key at least, and a key has 1 to {BITS} bits")
    text = normalised(F.col("text"))
    hashed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("norm")).withColumn("key", pseudo_key(F.col("norm"), bits))
    rows = table(hashed.select("doc_id", "key", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest")), "rows")
    claims = table(rows.groupBy("key", "digest").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id")), "claims")
    directory, last = _directory(claims.select("key"), capacity, bits)
    several = table(claims.groupBy("key").agg(F.sum("group_size").alias("n")).where("n > 1").select("key"), "several")
    wanted = hashed.join(F.broadcast(several), "key", "left_semi") if several.count() <= BROADCAST else hashed
    by_bytes = wanted.groupBy("key", "norm").agg(F.count("*").alias("group_size"), F.max("doc_id").alias("keep_id"))
    digested = by_bytes.select("key", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("digest"), "group_size", "keep_id")
    same = F.when(F.count("*") > 1, F.raise_error(F.lit("two texts have one key and one digest"))).otherwise(F.max("group_size"))
    chained = digested.groupBy("key", "digest").agg(same.cast("long").alias("group_size"), F.max("keep_id").alias("keep_id")).join(several, "key", "left_semi")
    alone = claims.join(several, "key", "left_anti").select("key", "digest", "group_size", "keep_id")
    addressed = _addressed(alone.unionByName(chained), directory, last)
    chain = F.expr("row_number() over (partition by bucket, key order by digest) - 1").alias("chain")
    owned = addressed.repartitionByRange(partitions(docs.sparkSession), "bucket", "key")  # an owner's range; a key's texts stay together
    entries = table(owned.select("bucket", "key", chain, "digest", "keep_id", "group_size").sortWithinPartitions("bucket", "key", "chain"), "entries")
    most = entries.agg(F.coalesce(F.max("group_size"), F.lit(1))).first()[0]
    return Index(rows, directory, entries, most)


def dedup(docs: DataFrame, capacity: int = 1 << 16, bits: int = BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 (of the normalised text) of every document, dropped ones too."""
    index = build(docs, capacity, bits)
    found = index.entries.where("group_size > 1").select("key", "digest", "keep_id", "group_size")
    out = lookup(index.rows, found, ["key", "digest"], "doc_id", index.most, "left")
    keep = F.coalesce("keep_id", "doc_id")
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("doc_id") == keep).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
