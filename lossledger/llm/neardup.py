"""Near-duplicate groups by b-bit MinHash, confirmed on full shingle sets.

1. Every document becomes its set of word shingles (64-bit hashes), the set's 128-bit digest and
   ``PERMUTATIONS`` minima. Bands of ``ROWS`` minima give bucket keys; of every minimum the low
   ``BITS`` bits are kept, packed into a signature.
2. Equal sets form a class; only one document per class goes on, so groups of exact copies of any
   size cost one row each.
3. Documents that share a bucket are candidates. Buckets are never expanded into all pairs:
   a. each member is compared with one leader, the member that shares most buckets with others;
   b. buckets with the same leader are taken together; members that are still in different
      components meet in blocks of bounded size, where signatures are compared by bit counts,
      corrected for chance collisions. No pair of a bucket is left out.
4. Every candidate is confirmed on the full sets; confirmed links join components by minimum label
   propagation with pointer jumping. Links, labels and buckets stay distributed.

A pair at the threshold shares a bucket with probability ``1 - (1 - t**ROWS)**BANDS`` (over 1 - 1e-8
at 0.85, 1 - 3e-6 at 0.8); estimates are taken ``SLACK`` below the threshold, five standard deviations.

Defined results: null, empty or wordless texts have no shingles and are linked with nothing; fewer
words than a shingle make one shingle of the whole; repeated rows of an id are the same document; a
null id is in no group; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, U64, chunks, hashed, list_array, mixed, signed, stored, windows_of, word_hashes

ROWS, BANDS, BITS = 5, 32, 4
PERMUTATIONS = ROWS * BANDS
SLACK = 0.15
#: Members that meet at a time, and their shingles; a longer document has a block of its own.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20

_random = np.random.default_rng(20)
_FACTORS = _random.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64) | U64(1)
_TERMS = _random.integers(0, 2**64, PERMUTATIONS, dtype=np.uint64)
_PLACES = mixed(np.arange(1, 1 << 16, dtype=np.uint64))


def shingles_of(words: list, table, width: int) -> np.ndarray:
    """Sorted hashes of the different shingles of ``width`` words; fewer words make one shingle."""
    if not words:
        return np.empty(0, U64)
    numbers = hashed(words, table)
    if len(words) < width:
        return windows_of(numbers, len(words)) + U64(len(words))
    return np.unique(windows_of(numbers, width))


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed low bits of the minima of each (non-empty) set."""
    flat = np.concatenate(sets)
    begins = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    minima = np.empty((PERMUTATIONS, len(sets)), U64)
    for k in range(PERMUTATIONS):
        minima[k] = np.minimum.reduceat((flat ^ _TERMS[k]) * _FACTORS[k], begins)
    minima = mixed(minima.T)
    keys = minima[:, ::ROWS].copy()
    for r in range(1, ROWS):
        keys = mixed(keys) + minima[:, r::ROWS]
    keys = mixed(keys + _PLACES[:BANDS])
    low = (minima & U64((1 << BITS) - 1)).astype(np.uint8)
    return keys, (low[:, ::2] << 4) | low[:, 1::2]


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of every signature in ``a`` with every one in ``b``.

    Equal low bits are counted and corrected for the ``2**-BITS`` that agree by chance.
    """
    x, y = np.ascontiguousarray(a).view(U64), np.ascontiguousarray(b).view(U64)
    low = U64(0x1111111111111111)
    differing = np.zeros((len(x), len(y)), np.int64)
    for k in range(x.shape[1]):
        d = x[:, k, None] ^ y[None, :, k]
        d |= d >> U64(2)
        d |= d >> U64(1)
        differing += np.bitwise_count(d & low)
    chance = 0.5**BITS
    return (1 - differing / PERMUTATIONS - chance) / (1 - chance)


def described(docs: DataFrame, width: int) -> DataFrame:
    """Per row: id, set size, digest, band keys and signature (null without shingles)."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_hashes()
        for batch in batches:
            for part, texts in chunks(batch, limit=1 << 20):
                sets = [shingles_of(t.translate(LOWER).split() if t else [], table, width) for t in texts]
                full = np.array([len(s) > 0 for s in sets], bool)
                digest = np.zeros((2, len(sets)), U64)
                keys, packed = np.empty((0, BANDS), U64), np.empty((0, PERMUTATIONS // 2), np.uint8)
                if full.any():
                    kept = [s for s in sets if len(s)]
                    keys, packed = signatures(kept)
                    digest[0, full] = [np.bitwise_xor.reduce(s) for s in kept]
                    digest[1, full] = [np.add.reduce(mixed(s)) for s in kept]
                digest = mixed(digest)
                blobs = iter(packed)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(signed(digest[0])), pa.array(signed(digest[1])),
                    list_array(signed(keys.ravel()), full * BANDS, pa.int64()),
                    pa.array([next(blobs).tobytes() if f else None for f in full], pa.binary()),
                ], ["doc_id", "n", "d1", "d2", "keys", "sig"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        describe, "doc_id bigint, n bigint, d1 bigint, d2 bigint, keys array<bigint>, sig binary")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """Per row: id and the full sorted set of shingle hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_hashes()
        for batch in batches:
            for part, texts in chunks(batch):
                found = [shingles_of(t.translate(LOWER).split() if t else [], table, width) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), pa.array([signed(s).tobytes() for s in found], pa.binary())], ["node", "shingles"])

    return docs.mapInArrow(sets, "node bigint, shingles binary")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) with ``100 * intersection >= threshold * union`` of the full sets."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            linked = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.int64) for v in (x, y))
                common = len(x) + len(y) - len(np.union1d(x, y))
                linked.append(100 * common >= threshold * (len(x) + len(y) - common))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    with_a = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")
    both = with_a.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    # A set cannot reach the threshold with one whose size differs too much.
    small, large = F.least(F.length("sa"), F.length("sb")), F.greatest(F.length("sa"), F.length("sb"))
    return both.filter(100 * small >= threshold * large).select("a", "b", "sa", "sb").mapInArrow(compare, "a bigint, b bigint")


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b): the smallest node reachable."""
    links = stored(links.filter("a <> b").distinct())
    both = links.union(links.select("b", "a"))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")))
    while True:
        # The smallest label among neighbours, then the label of that label.
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        hop = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("c"))
        jump = labels.select(F.col("node").alias("c"), F.col("component").alias("further"))
        # A hop is passed to the old label as well, so long chains close fast.
        passed = hop.groupBy(F.col("old").alias("c")).agg(F.min("c").alias("passed"))
        new = (
            hop.join(jump, "c", "left").withColumn("c", F.least("c", "further")).select("node", "old", "c")
            .join(passed.select(F.col("c").alias("node"), "passed"), "node", "left")
            .select("node", "old", F.least("c", "passed").alias("component"))
        )
        new = stored(new)
        labels = new.select("node", "component")
        if new.filter("old <> component").isEmpty():
            return labels


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Component labels after further links; ``links`` are between nodes, labels may be missing."""
    if labels is None:
        return components(links)
    old = labels.select(F.col("node").alias("n"), F.col("component").alias("c"))

    def root(name: str) -> Column:
        return F.coalesce(F.col(f"{name}_c"), F.col(name))

    def with_root(df: DataFrame, name: str) -> DataFrame:
        return df.join(old.withColumnRenamed("n", name).withColumnRenamed("c", f"{name}_c"), name, "left")

    lifted = with_root(with_root(links, "a"), "b").select(root("a").alias("a"), root("b").alias("b"))
    new = components(lifted).select(F.col("node").alias("root"), F.col("component").alias("now"))
    nodes = new.select(F.col("root").alias("node"), F.col("root").alias("component")).join(labels, "node", "left_anti")
    return stored(
        labels.union(nodes).join(new, F.col("component") == F.col("root"), "left")
        .select("node", F.coalesce("now", "component").alias("component"))
    )


def gathered(buckets: DataFrame) -> DataFrame:
    """(leader, node): every bucket's members under the one that shares most buckets with others.

    Buckets with the same leader become one, so a group that meets in many bands is looked at once.
    """
    sizes = buckets.groupBy("key").agg(F.count("*").alias("size"))
    weight = buckets.join(sizes, "key").groupBy("node").agg(F.sum("size").alias("weight"))
    # Ties go to the smaller node; one maximum of a pair, combined in every task.
    leaders = (
        buckets.join(weight, "node").groupBy("key")
        .agg(F.max_by("node", F.struct("weight", -F.col("node"))).alias("leader"))
    )
    return buckets.join(leaders, "key").select("leader", "node").distinct()


def apart(gathering: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members of gatherings that hold several components, dealt to blocks (leader, x, y) that meet.

    ``side`` 0: members outside the gathering's largest component, 1: all members. Every pair of
    members in different components meets in one block, which is bounded in rows and in shingles.
    """
    now = gathering.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).join(sizes, "node")
    per = now.groupBy("leader", "component").agg(F.count("*").alias("rows"), F.sum("n").alias("words"))
    main = per.groupBy("leader").agg(
        F.max_by("component", F.struct("rows", "component")).alias("main"), F.sum("rows").alias("rows"), F.sum("words").alias("words"),
        F.max("rows").alias("main_rows"), F.max_by("words", F.struct("rows", "component")).alias("main_words"))

    def blocks(rows: Column, words: Column) -> Column:
        return F.ceil(F.greatest(rows / BLOCK, words / BLOCK_SHINGLES)).cast("int")

    main = main.filter("main_rows < rows").select(
        "leader", "main", blocks(F.col("rows"), F.col("words")).alias("many"),
        blocks(F.col("rows") - F.col("main_rows"), F.col("words") - F.col("main_words")).alias("few"))
    split = now.join(main, "leader").withColumn("place", F.xxhash64("node"))
    columns = ["leader", "node", "component"]
    every = split.select(*columns, F.pmod("place", "many").cast("int").alias("y"), F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("x"), F.lit(1).alias("side"))
    outside = split.filter("component <> main").select(
        *columns, F.explode(F.sequence(F.lit(0), F.col("many") - 1)).alias("y"), F.pmod("place", "few").cast("int").alias("x"), F.lit(0).alias("side"))
    return every.unionByName(outside)


def block_links(blocks: DataFrame, described_nodes: DataFrame, threshold: int) -> DataFrame:
    """Confirmed links between different components of a block, one for each two components it joins.

    Bit counts choose the candidates; their full sets decide. Components that a link joins are one from
    then on, so a block gives fewer links than it has members.
    """
    least = threshold / 100 - SLACK

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        few, every = frame[frame.side == 0], frame[frame.side == 1]
        found: list[tuple[int, int]] = []
        if len(few) and len(every):
            sig = lambda f: np.stack([np.frombuffer(s, np.uint8) for s in f.sig])
            estimate = similarity(sig(few), sig(every))
            sets = [np.frombuffer(s, np.int64) for s in every.shingles]
            size = np.array([len(s) for s in sets])
            begin = np.cumsum(size) - size
            known, number = np.unique(np.concatenate(sets), return_inverse=True)
            mine, theirs = few.component.to_numpy().copy(), every.component.to_numpy().copy()
            nodes = every.node.to_numpy()
            for k, (node, shingles) in enumerate(zip(few.node, few.shingles, strict=True)):
                candidate = (estimate[k] >= least) & (theirs != mine[k])
                if not candidate.any():
                    continue
                own = np.frombuffer(shingles, np.int64)
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                held = np.zeros(len(known), np.int64)
                held[at[known[at] == own]] = 1
                common = np.add.reduceat(held[number], begin)
                linked = candidate & (100 * common >= threshold * (size + len(own) - common))
                for other in np.unique(theirs[linked]):
                    found.append((node, nodes[np.flatnonzero(linked & (theirs == other))[0]]))
                joined = np.unique(theirs[linked])
                now = mine[k]
                theirs[np.isin(theirs, joined)] = now
                mine[np.isin(mine, joined)] = now
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": pairs.min(1), "b": pairs.max(1)}) if len(pairs) else pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return blocks.join(described_nodes, "node").groupBy("leader", "x", "y").applyInPandas(meet, "a bigint, b bigint")


def groups(docs: DataFrame, width: int = 3, threshold: int = 85) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    ``threshold`` is the least similarity in percent.
    """
    rows = stored(described(docs, width))
    classes = rows.filter("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("node"))
    members = stored(rows.filter("n > 0 AND doc_id IS NOT NULL").select("doc_id", "d1", "d2").distinct()
                     .join(classes, ["d1", "d2"]).select("doc_id", "node"))
    nodes = rows.join(members.select(F.col("node").alias("doc_id")).distinct(), "doc_id", "left_semi").filter("n > 0")
    nodes = nodes.groupBy(F.col("doc_id").alias("node")).agg(F.min("sig").alias("sig"), F.min("keys").alias("keys"))
    buckets = nodes.select("node", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    buckets = stored(buckets.join(shared, "key"))
    involved = buckets.select("node").distinct()
    texts = docs.select(F.col("doc_id").cast("bigint").alias("node"), "text")
    sets = shingle_sets(texts.join(involved, "node", "left_semi"), width).groupBy("node").agg(F.min("shingles").alias("shingles"))
    sets = stored(sets)
    small = stored(nodes.join(involved, "node", "left_semi").select("node", "sig"))

    # Two classes may hold the same id (rows that repeat it with another text): one document.
    labels = merged(None, members.select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
                    .filter("a <> b").groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("c")).filter("c > 1").select("a", "b"))
    gathering = stored(gathered(buckets))
    pairs = gathering.filter("leader <> node").select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    labels = merged(labels, confirmed(pairs, sets, threshold))
    blocks = apart(gathering, labels, sets.select("node", (F.length("shingles") / 8).alias("n")))
    labels = merged(labels, block_links(blocks, small.join(sets, "node"), threshold))

    final = members.join(labels, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("component_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(final, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_per_group(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """``docs`` without the documents that are not the smallest id of their group, columns unchanged."""
    dropped = groups(docs.select("doc_id", "text"), width, threshold).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
