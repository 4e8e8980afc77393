"""SimHash near-dedup with deletion-variant signatures.

Fingerprints that differ in at most ``d`` bits are cut into ``d // 2 + 1`` segments, so that
at least one segment differs by at most one bit. Every segment is indexed with each of its
bits replaced by a wildcard; fingerprints that share such a variant meet by an equality key
and are verified on all 64 bits. Only distinct fingerprints are indexed (copies collapse
first), and the members of a variant with many of them are linked by a search that leaves a spanning forest: a bucket of m
fingerprints gives at most m - 1 links. Buckets of at most 48 are compared pair by pair.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_schema, as_batches, column, map_batches, text_of, trim, tune
from .graph import components

BITS, SEED = 64, 42
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str, shingle: int = 4) -> int:
    """Bits set in more than half of the shingles' XXH64; 0 for a text without words."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    pieces = zip(*(words[k:] for k in range(shingle)))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter(map(digest, map(b" ".join, pieces), repeat(SEED)), np.uint64, len(words) - shingle + 1)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 1 << 14):  # bounds the memory of very long texts
        part = h[k : k + (1 << 14)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(h)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batch: pa.RecordBatch) -> dict:
        fps = np.fromiter((fingerprint(t, shingle) for t in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
        return {"doc_id": batch.column(0), "fp": pa.array(fps.view(np.int64))}

    narrow = docs.select(column(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    return map_batches(narrow, run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, fp long")


def segments(distance: int) -> list[tuple[int, int]]:
    """(first bit, width) of the fewest segments of which one differs by at most one bit."""
    n = distance // 2 + 1
    cuts = [round(BITS * k / n) for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _long(bits: int):
    """The 64 bits as a signed literal."""
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def variants(nodes: DataFrame, distance: int) -> DataFrame:
    """key, fp: one row for each one-wildcard variant.

    The key hashes the wildcard's place and the segment's other bits. Keys that meet by chance
    only cost a comparison, since every link is verified on all bits.
    """
    keys = []
    for first, width in segments(distance):
        part = F.shiftrightunsigned("fp", first).bitwiseAND(_long((1 << width) - 1))
        for k in range(width):
            rest = part.bitwiseAND(_long(((1 << width) - 1) & ~(1 << k)))
            keys.append(F.xxhash64(F.lit(first + k), rest))
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp")


def forest(x: np.ndarray, distance: int) -> tuple[list, list]:
    """Links that join exactly what is reachable by steps of at most ``distance`` bits among x."""
    left, right = [], []
    while len(x) > 1:
        frontier, x = [x[0]], x[1:]
        while frontier and len(x):
            at = frontier.pop()
            near = np.bitwise_count(x ^ at) <= distance
            if near.any():
                met = x[near]
                left.append(np.full(len(met), at))
                right.append(met)
                frontier.extend(met)
                x = x[~near]
    return left, right


def bucket_links(keyed: DataFrame, distance: int, small: int = 48) -> DataFrame:
    """Links (u, v) among fingerprints with the same key. keyed: sorted by key within each partition."""
    target, arrow = arrow_schema(keyed.sparkSession, "u long, v long")

    def link(key: np.ndarray, fp: np.ndarray):
        head = np.ones(len(key), bool)
        head[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(head)
        size = np.diff(np.append(start, len(key)))
        left, right = [], []
        in_small = np.repeat(size <= small, size)
        k2, f2 = key[in_small], fp[in_small]
        for lag in range(1, int(size[size <= small].max(initial=1))):
            near = (k2[lag:] == k2[:-lag]) & (np.bitwise_count(f2[lag:] ^ f2[:-lag]) <= distance)
            left.append(f2[:-lag][near])
            right.append(f2[lag:][near])
        for g in np.flatnonzero(size > small):
            a, b = forest(fp[start[g] : start[g] + size[g]], distance)
            left += a
            right += b
        if left and sum(map(len, left)):
            u, v = np.concatenate(left), np.concatenate(right)
            u, v = np.maximum(u, v), np.minimum(u, v)
            order = np.lexsort((v, u))
            u, v = u[order], v[order]
            new = np.ones(len(u), bool)
            new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
            yield from as_batches({"u": pa.array(u[new].view(np.int64)), "v": pa.array(v[new].view(np.int64))}, arrow)

    def run(batches):
        keys, fps = [], []
        for b in batches:
            if not b.num_rows:
                continue
            keys.append(b.column(0).to_numpy(zero_copy_only=False))
            fps.append(b.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            if keys[0][0] != keys[-1][-1] and sum(map(len, keys)) >= 200_000:
                key, fp = np.concatenate(keys), np.concatenate(fps)
                cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                yield from link(key[:cut], fp[:cut])
                keys, fps = [key[cut:]], [fp[cut:]]
        if keys:
            yield from link(np.concatenate(keys), np.concatenate(fps))
        trim()

    return keyed.mapInArrow(run, target)


def simhash_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4, shingle: int = 4
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable by links of at most ``distance`` differing bits.
    Null and empty texts have the fingerprint zero, which links like any other. Rows that repeat
    an id keep a row each. A null id stays in the result but is never a component_id unless its
    whole component has none. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "simhash")
    fps = scratch.write(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = scratch.write(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = variants(nodes, distance).repartition(parts, "key").sortWithinPartitions("key", "fp")
    links = scratch.write(bucket_links(keyed, distance), "links")
    roots = components(scratch, links)
    rooted = scratch.write(
        nodes.join(roots, nodes.fp == roots.u, "left").select("fp", "low", F.coalesce("v", "fp").alias("root")), "rooted"
    )
    low = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    labels = scratch.write(rooted.select("fp", "root").join(low, "root").select("fp", "component_id"), "labels")
    return fps.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
