"""WARC fixity audit with Merkle trees.

Each volume (a WARC file) has VOLUME slots in the order of its records' offsets; a record's slot follows from
its id, so that a lost or an additional record moves no other one to another slot. A leaf of the tree is a
slot: the number, the length and the sum of the SHA-256 digests of its records. A node covers an ordered range
of slots, and above the volumes a range of volumes: its hash is the SHA-256 of its children's places, lengths
and hashes. Two replicas are compared from the root: equal roots end the audit, and otherwise only the children
of nodes that differ are looked at, down to the slots, in which the records themselves are compared. All of it
is DataFrame code: records never shuffle, only their digests do, and a node has FANOUT children at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, column, text_of

FANOUT_BITS = 5
FANOUT = 1 << FANOUT_BITS
#: Slots of one volume, a power of FANOUT.
VOLUME_BITS = 10
VOLUME = 1 << VOLUME_BITS
#: Volumes over which records without an id are dealt by their hash.
_NAMELESS = 1 << 16


def warc_records(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """page_id, volume, record: each page as a WARC resource record. Null url or body counts as empty, a null id gives volume -1.

    The pages don't say when they were fetched; ``date`` is the mandatory WARC-Date of all records.
    """
    body = text_of(body_col)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), text_of(url_col), F.lit(f"\r\nWARC-Date: {date}"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(column(id_col).cast("string"), F.lit("")),
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    key = column(id_col).cast("long")
    return pages.select(
        key.alias("page_id"),
        F.coalesce(F.floor(key / VOLUME), F.lit(-1)).cast("long").alias("volume"),
        F.concat(head, body, F.lit("\r\n\r\n")).alias("record"),
    )


def hashed(records: DataFrame) -> DataFrame:
    """page_id, volume, length, hash, and the leaf: tree (the volume, or one of _NAMELESS for records without an id), slot."""
    out = records.select(
        "page_id", "volume", F.octet_length("record").cast("long").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("hash")
    )
    spread = F.pmod(F.xxhash64("hash"), F.lit(_NAMELESS * VOLUME))
    nameless = F.col("page_id").isNull()
    return out.select(
        "*",
        F.when(nameless, -1 - F.floor(spread / VOLUME)).otherwise(F.coalesce("volume", F.lit(-1))).cast("long").alias("tree"),
        F.when(nameless, F.pmod(spread, F.lit(VOLUME))).otherwise(F.pmod("page_id", F.lit(VOLUME))).cast("long").alias("slot"),
    )


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` with place (in the volume, from 0) and offset, both null for records without an id. rows: of ``hashed``."""
    order = Window.partitionBy("tree").orderBy("page_id", "hash")
    named = F.col("page_id").isNotNull()
    return rows.select(
        "*",
        F.when(named, F.row_number().over(order) - 1).cast("long").alias("place"),
        F.when(named, F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("offset"),
    )


def _leaves(rows: DataFrame) -> DataFrame:
    """tree, place, length, hash of each slot in use. However many records a slot has, a task sends one row for it."""
    quarters = [F.sum(F.conv(F.substring("hash", 16 * k + 1, 16), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return rows.groupBy("tree", F.col("slot").alias("place")).agg(
        F.sum("length").alias("length"), F.sha2(F.concat_ws(":", F.count(F.lit(1)), *quarters).cast("binary"), 256).alias("hash")
    )


def _above(nodes: DataFrame) -> DataFrame:
    """The next level within each tree."""
    text = lambda x: F.concat_ws(":", x["place"], x["length"], x["hash"])
    parent = F.shiftright("place", FANOUT_BITS).alias("parent")
    grouped = nodes.groupBy("tree", parent).agg(F.sort_array(F.collect_list(F.struct("place", "length", "hash"))).alias("c"))
    return grouped.select(
        "tree",
        F.col("parent").alias("place"),
        F.aggregate("c", F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("length"),
        F.sha2(F.array_join(F.transform("c", text), ";").cast("binary"), 256).alias("hash"),
    )


def merkle_levels(scratch: Scratch, rows: DataFrame, height: int) -> list[DataFrame]:
    """The levels of a replica's tree, slots first, the root last; ``height`` of them lie above the volumes."""
    levels = [scratch.write(_leaves(rows), "leaves")]
    inner = VOLUME_BITS // FANOUT_BITS
    for k in range(1, inner + height + 1):
        level = _above(levels[-1])
        if k == inner:
            level = level.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), "length", "hash")
        levels.append(scratch.write(level, "nodes"))
    return levels


def _differ(a: DataFrame, b: DataFrame, within: DataFrame | None) -> DataFrame:
    """(tree, place) of nodes whose hashes differ or that one side lacks; only below the nodes ``within``."""
    both = a.select("tree", "place", "hash").unionByName(b.select("tree", "place", "hash"))
    if within is not None:
        asked = within.select("tree", F.col("place").alias("parent"))
        both = both.withColumn("parent", F.shiftright("place", FANOUT_BITS)).join(asked, ["tree", "parent"], "left_semi")
    met = both.groupBy("tree", "place").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("low"), F.max("hash").alias("high"))
    return met.where("n < 2 or low <> high").select("tree", "place")


def differing_slots(scratch: Scratch, left: list[DataFrame], right: list[DataFrame]) -> DataFrame:
    """(tree, slot) of the slots that differ, found from the root along nodes that differ."""
    nodes, inner = None, VOLUME_BITS // FANOUT_BITS
    for k in range(len(left) - 1, -1, -1):
        if k == inner - 1:  # from the volumes into them
            nodes = nodes.select(F.col("place").alias("tree"), F.lit(0).cast("long").alias("place"))
        nodes = scratch.write(_differ(left[k], right[k], nodes), "differ")
    return nodes.select("tree", F.col("place").alias("slot"))


def _height(*replicas: DataFrame) -> int:
    """Levels above the volumes until two nodes at most are left, one of them for negative numbers."""
    most = max((r.agg(F.max(F.abs("tree"))).first()[0] or 0) for r in replicas)
    height = 0
    while most >> (FANOUT_BITS * height):
        height += 1
    return height


def audit(records: DataFrame, replica: DataFrame) -> DataFrame:
    """One row per record: page_id, volume, place, offset, length, sha256, status, intact; then a row per surplus record of the replica.

    records and replica: page_id, volume, record, as of ``warc_records``; other columns are ignored. A record
    and one of the replica under the same volume and id that hold the same bytes are a pair, each record in one
    pair at most. status: ``intact`` with a pair; ``corrupt`` without one where the replica has a record without
    a pair under that id, too; ``missing`` where it has none; ``extra`` for a record of the replica where the
    others have none without a pair. Of records with equal bytes the first have the pairs. place and offset follow
    from the order of page_id, then hash; they are null for surplus records and for those with a null page_id,
    which are compared by their bytes alone (all of equal ones are missing if any is). Empty tables give no rows.
    """
    scratch = Scratch(records.sparkSession, "fixity")
    mine = scratch.write(placed(hashed(records)), "records")
    other = scratch.write(hashed(replica), "replica")
    height = _height(mine, other)
    slots = differing_slots(scratch, merkle_levels(scratch, mine, height), merkle_levels(scratch, other, height))
    key = ["tree", "slot", "volume", "page_id", "hash"]
    count = lambda df, name, *more: df.join(slots, ["tree", "slot"], "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias(name), *more)
    a = count(mine, "n", F.min("place").alias("first"))
    b = count(other, "m", F.max("length").alias("length")).select(*(F.col(k).alias(f"_{k}") for k in key), "m", "length")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    met = a.join(b, [x for x in same], "full").select(
        *(F.coalesce(k, f"_{k}").alias(k) for k in key), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("m", F.lit(0)).alias("m"), "first", "length"
    )
    met = scratch.write(met.where("n <> m"), "unpaired")
    owner = ["tree", "slot", "volume", "page_id"]
    sums = met.groupBy(*owner).agg(F.sum(F.greatest(F.col("n") - F.col("m"), F.lit(0))).alias("lost"), F.sum(F.greatest(F.col("m") - F.col("n"), F.lit(0))).alias("more"))
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in owner), "lost", "more")
    # bytes are all that nameless records have in common: a lost one has no counterpart
    named = F.col("page_id").isNotNull()
    marked = met.join(sums, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in owner]).select(
        *key, "n", "m", "first", "length", (named & (F.col("lost") > 0)).alias("lost"), (named & (F.col("more") > 0)).alias("more")
    )
    marked = scratch.write(marked, "marked")
    bad = marked.where("n > m").select(*(F.col(k).alias(f"_{k}") for k in key), "m", "first", F.when(F.col("more"), "corrupt").otherwise("missing").alias("fault"))
    faulty = F.coalesce(F.col("place").isNull() | (F.col("place") - F.col("first") >= F.col("m")), F.lit(False))
    status = F.when(F.col("fault").isNotNull() & faulty, F.col("fault")).otherwise("intact")
    shown = mine.join(bad, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], "left").select(
        "page_id", "volume", "place", "offset", "length", F.col("hash").alias("sha256"), status.alias("status")
    )
    surplus = marked.where("m > n and not lost").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("n"))))
    extra = surplus.select(
        "page_id", "volume", F.lit(None).cast("long").alias("place"), F.lit(None).cast("long").alias("offset"), "length",
        F.col("hash").alias("sha256"), F.lit("extra").alias("status"),
    )
    return shown.unionByName(extra).withColumn("intact", F.col("status") == "intact")
