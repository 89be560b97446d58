"""Near duplicates by SimHash with deletion-variant signatures.

A document's fingerprint has 64 bits, from the XXH64 (seed 42) of its word shingles. Two
fingerprints link when at most four bits differ. They are cut into three segments, so that
one segment of a linked pair differs by at most one bit. Each segment is indexed once per
wildcard position (the segment without that bit): a linked pair shares at least one such
variant. Equal variants meet in an equality join and pairs are verified on all 64 bits.

Equal fingerprints are one node. Equal whole segments come first: every node is compared with
a few centres of its segment, then nodes that are still in different components with each
other. Only variants that still hold several components are looked at, and the largest
component of a key is never compared with itself. So a group of near copies costs about its
size, not its square, and no link between components is lost.

Nulls: a null text counts as empty; texts without words have fingerprint zero and are linked
like any other. Rows with a null ``doc_id`` get a fingerprint and the component of their
fingerprint. Repeated rows are kept. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from sparselens.llm.common import components, staged

SHINGLE_WORDS, SEED, MAX_BITS = 4, 42, 4
#: Widths of the segments from the lowest bit: one more than half of MAX_BITS segments.
SEGMENTS = (22, 21, 21)


def fingerprint(text, words=SHINGLE_WORDS):
    """The fingerprint as eight bytes, high bit first."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return bytes(8)
    joined, digest = b" ".join(found), xxhash.xxh64_digest
    if len(found) <= words:
        hashes, count = digest(joined, SEED), 1
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate([[0], ends[:-words] + 1])
        hashes = b"".join([digest(joined[s:e], SEED)
                           for s, e in zip(starts.tolist(), ends[words - 1:].tolist())])
        count = len(starts)
    ones = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(count, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > count).tobytes()


def fingerprints(docs):
    """(doc_id, fp): the fingerprint as a signed long; one Arrow pass."""
    def run(batches):
        for batch in batches:
            raw = b"".join([fingerprint(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def variants(column):
    """All one-wildcard segment variants of a fingerprint: wildcard position and kept bits in one long."""
    keys, low = [], 0
    for width in SEGMENTS:
        segment = F.shiftrightunsigned(column, low).bitwiseAND(F.lit((1 << width) - 1))
        for i in range(width):
            kept = segment.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << i)))
            keys.append(kept.bitwiseOR(F.lit((low + i) << max(SEGMENTS))))
        low += width
    return F.array(*keys)


def near(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= MAX_BITS


def segments(column):
    """The segments themselves, each with its place."""
    low, keys = 0, []
    for i, width in enumerate(SEGMENTS):
        segment = F.shiftrightunsigned(column, low).bitwiseAND(F.lit((1 << width) - 1))
        keys.append(segment.bitwiseOR(F.lit(i << max(SEGMENTS))))
        low += width
    return F.array(*keys)


def merge(nodes, links):
    """``nodes`` (fp, weight, label) after the labels that ``links`` (a, b) name became one."""
    links = staged(links.where("a <> b").distinct(), "links")
    if links.isEmpty():
        return nodes
    found = components(links).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return staged(nodes.join(staged(found, "merged"), "label", "left")
                  .select("fp", "weight", F.coalesce("to", "label").alias("label")), "nodes")


def unsettled(rows, wildcard=None):
    """The rows (key, fp, weight, label) of keys that hold several labels and more than two
    fingerprints, and the links of those that hold just two. ``wildcard`` is the bit a key leaves
    out: where all rows agree in it, equal segments have linked them before."""
    found = [F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.min("label").alias("la"), F.max("label").alias("lb")]
    if wildcard is not None:
        found += [F.min(wildcard).alias("off"), F.max(wildcard).alias("on")]
    shared = rows.groupBy("key").agg(*found).where("la < lb")
    shared = staged(shared if wildcard is None else shared.where("off < on"), "shared")
    pairs = shared.where("n = 2").where(near("a", "b")).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    return staged(rows.join(shared.where("n > 2").select("key"), "key", "left_semi"), "members"), pairs


def stars(rows, order):
    """Links of every row to the first one of its key in ``order``."""
    first = staged(rows.groupBy("key").agg(F.max_by(F.struct("fp", "label"), F.struct(order, "fp")).alias("c"))
                   .select("key", F.col("c.fp").alias("b"), F.col("c.label").alias("lb")), "centres")
    return (rows.join(first, "key").where("label <> lb").where(near("fp", "b"))
            .select(F.col("label").alias("a"), F.col("lb").alias("b")))


def bridges(rows):
    """All links between labels that share a key; the most common label of a key is not
    compared with itself."""
    sizes = rows.groupBy("key", "label").agg(F.count("*").alias("n"))
    hubs = staged(sizes.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("hub"), F.count("*").alias("labels"))
                  .where("labels > 1"), "hubs")
    still = staged(rows.join(hubs, "key"), "open")
    left = still.where("label <> hub").select("key", F.col("fp").alias("a"), F.col("label").alias("la"))
    right = still.select("key", F.col("fp").alias("b"), F.col("label").alias("lb"), "hub")
    return (left.join(right, "key").where("la <> lb and (lb = hub or la < lb)").where(near("a", "b"))
            .select(F.col("la").alias("a"), F.col("lb").alias("b")))


def link(nodes):
    """(fp, label) of all fingerprints; ``nodes`` is (fp, weight)."""
    nodes = nodes.select("fp", "weight", F.col("fp").alias("label"))
    keyed = lambda keys: nodes.select("fp", "weight", "label", F.explode(keys(F.col("fp"))).alias("key"))
    # Equal segments first: they hold most links of a group, in three rows a fingerprint.
    for order in (F.col("weight"), F.xxhash64("fp"), F.xxhash64("fp", F.lit(1))):
        rows, pairs = unsettled(keyed(segments))
        nodes = merge(nodes, pairs.union(stars(rows, order)))
    rows, pairs = unsettled(keyed(segments))
    nodes = merge(nodes, pairs.union(bridges(rows)))
    # One-wildcard variants of what is still apart.
    left_out = F.expr(f"shiftrightunsigned(fp, int(shiftright(key, {max(SEGMENTS)}))) & 1")
    rows, pairs = unsettled(keyed(variants), left_out)
    nodes = merge(nodes, pairs.union(bridges(rows)))
    return nodes.select("fp", "label")


def near_duplicates(docs):
    """(doc_id, fingerprint, component_id): 16 hex digits; the smallest doc_id that is reachable."""
    prints = staged(fingerprints(docs), "fingerprints")
    nodes = staged(prints.groupBy("fp").agg(F.count("*").alias("weight"), F.min("doc_id").alias("first")), "nodes")
    labels = staged(link(nodes.select("fp", "weight")), "labels")
    named = staged(nodes.join(labels, "fp").select("fp", "first", "label"), "named")
    smallest = staged(named.groupBy("label").agg(F.min("first").alias("component_id")), "smallest")
    of_print = staged(named.join(smallest, "label").select("fp", "component_id"), "classes")
    return prints.join(of_print, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs):
    """The documents without near duplicates: of each component the row with the smallest doc_id.

    Rows without ``doc_id`` stay, since nothing tells them apart; of rows that repeat the kept
    ``doc_id`` one stays.
    """
    named = staged(near_duplicates(docs), "classes")
    keep = named.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(keep, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where("doc_id is null"))
