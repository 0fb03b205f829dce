"""Near-duplicates by fast similarity sketching, banding and exact verification.

A document's set is its distinct five-word shingles. Its sketch has COORDINATES
coordinates filled in rounds: in each of the first COORDINATES rounds every
shingle is hashed to a random coordinate, in each of the next to one given
coordinate, and a coordinate keeps the smallest hash of the earliest round that
reached it. So every coordinate fills, the expected work is linear in the set
plus t ln t, and the share of equal coordinates estimates the Jaccard
similarity with concentration bounds as for independent hashes.

Documents with the same set form a class, and one document of each class goes
on. Sketches are cut into BANDS bands of ROWS coordinates; at similarity 0.75
two sets miss each other in all bands with a chance of 2 in a million. Links are
confirmed on full sets:

1. every member of a bucket against the bucket's smallest id, linear in the bucket;
2. in buckets whose members are not connected by then, a spanning forest of the
   most alike pairs between components, linear in the bucket again;
3. in buckets still not connected, every remaining pair between components,
   each in the first band whose bucket holds it.

Steps 2 and 3 skip pairs whose sizes or sketches exclude the similarity (sketches
by five standard deviations). Components are found on the cluster, by
contraction; only counts of edges reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, WordIds, ascii_words, flagged, lookup, materialize, mix64, screen, shingle_hashes, values

BANDS, ROWS = 48, 5
COORDINATES = BANDS * ROWS
PERCENT = 75
#: Coordinates of 8 bits that agree for any pair of the similarity, less five standard deviations.
AGREE = int(COORDINATES * (0.75 - 5 * (0.75 * 0.25 / COORDINATES) ** 0.5))
#: Pairs that meet one copy of a leader's set; beyond that, the leader's pairs are dealt over several copies.
PAIRS_A_COPY = 1024
#: Members of a bucket that one task compares with each other; larger ones are cut.
BLOCK_MEMBERS = 2048
#: Shingles of a chunk of a bucket, at 8 bytes each.
BLOCK_ELEMENTS = 4_000_000
#: The low bits of a bucket's key tell its band.
BAND_MASK = 63
_VALUE = np.uint64((1 << 40) - 1)


def shingle_set(ids: np.ndarray) -> np.ndarray:
    return np.unique(shingle_hashes(ids, 5))


def sketch(elements: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The ``t`` coordinates (round and 40 bits of hash) of a non-empty set of uint64."""
    out = np.full(t, np.uint64(0xFFFFFFFFFFFFFFFF))
    n = len(elements)
    batch = max(1, int(t * (np.log(t) + 2) / n) + 1)
    with np.errstate(over="ignore"):
        for first in range(0, t, batch):
            rounds = np.arange(first, min(first + batch, t), dtype=np.uint64)
            h = mix64(elements[None, :] + ((rounds + np.uint64(1)) * GOLDEN)[:, None])
            place = ((h >> np.uint64(40)) * np.uint64(t)) >> np.uint64(24)
            np.minimum.at(out, place.ravel().astype(np.int64), ((rounds << np.uint64(40))[:, None] | (h & _VALUE)).ravel())
            if out.max() != 0xFFFFFFFFFFFFFFFF:
                return out
        for c in np.flatnonzero(out == np.uint64(0xFFFFFFFFFFFFFFFF)):
            r = np.uint64(t + int(c))
            out[c] = (r << np.uint64(40)) | (mix64(elements + (r + np.uint64(1)) * GOLDEN) & _VALUE).min()
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = mix64(coordinates.reshape(BANDS, ROWS) + np.arange(ROWS, dtype=np.uint64) * GOLDEN)
        keys = np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN
        for j in range(ROWS):
            keys = mix64(keys ^ rows[:, j])
    return ((keys & ~np.uint64(BAND_MASK)) | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    words = WordIds()
    names = ["doc_id", "n_shingles", "set_key", "bands", "bits"]
    for batch in batches:
        n, keys, bands, bits = [], [], [], []
        for text in values(batch.column(1).cast(pa.binary())):
            elements = shingle_set(words.of(ascii_words(text or b"")))
            n.append(len(elements))
            if len(elements):
                coordinates = sketch(elements)
                keys.append(hashlib.blake2b(elements.tobytes(), digest_size=16).digest())
                bands.append(band_keys(coordinates))
                bits.append(mix64(coordinates).astype(np.uint8).tobytes())
            else:
                keys.append(None)
                bands.append(None)
                bits.append(None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=names
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordIds()
    for batch in batches:
        sets = [shingle_set(words.of(ascii_words(t or b""))).tobytes() for t in values(batch.column(1).cast(pa.binary()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "elements"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def element_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, elements) of those documents; only their texts move."""
    ids = materialize(ids.distinct(), "to_verify")
    texts = screen(docs.select(F.col("doc_id").alias("id"), "text"), "id", ids).join(ids.hint("merge"), "id", "left_semi")
    return materialize(texts.mapInArrow(_sets, "id long, elements binary"), "sets")


def verify(edges: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of ``edges`` (a, b) whose full sets reach the similarity.

    A leader ``a`` of more than PAIRS_A_COPY pairs has its set repeated, once
    for each PAIRS_A_COPY of them, so a group of any size is spread over tasks.
    """
    sets = element_sets(edges.select(F.explode(F.array("a", "b")).alias("id")), docs)
    copies = F.ceil(F.count(F.lit(1)) / PAIRS_A_COPY).cast("int").alias("copies")
    hot = lookup(materialize(edges.groupBy("a").agg(copies).filter("copies > 1"), "hot_leaders"))
    side = lambda x: sets.select(F.col("id").alias(x), F.col("elements").alias(f"e{x}"))
    dealt = edges.join(hot, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("copies")), F.lit(0)).cast("int").alias("copy"))
    leaders = side("a").join(hot, "a", "left").select("a", "ea", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    pairs = dealt.join(side("b").hint("merge"), "b").join(leaders.hint("merge"), ["a", "copy"])  # both grow with the data
    return materialize(pairs.select("a", "b", "ea", "eb").mapInArrow(_linked, "a long, b long"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (a, b): the smallest id that it reaches.

    Each vertex points to its smallest neighbour if that is smaller; pointers
    are doubled until they reach roots, and edges are contracted to the roots.
    A path, a star or a dense group collapses in one or two contractions.
    """
    spark = edges.sparkSession
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("w")))
        up = materialize(both.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("p")), "pointers")
        while True:
            jump = up.select(F.col("v").alias("p"), F.col("p").alias("q"))
            after = materialize(up.join(jump, "p").select("v", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "pointers")
            moved = not after.filter("moved").isEmpty()
            up = after.select("v", "p")
            if not moved:
                break
        found = up if found is None else materialize(found.join(up.select(F.col("v").alias("p"), F.col("p").alias("q")), "p", "left").select("v", F.coalesce("q", "p").alias("p")), "roots")
        side = lambda x: up.select(F.col("v").alias(x), F.col("p").alias(f"r{x}"))
        moved_edges = edges.join(side("a"), "a").join(side("b"), "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        edges = materialize(moved_edges.filter("a < b").distinct(), "edges")
    if found is None:
        return spark.createDataFrame([], "id long, component long")
    return found.select(F.col("v").alias("id"), F.col("p").alias("component"))


def _forest(comp: np.ndarray, a: np.ndarray, b: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Indices of the pairs (a, b) of a spanning forest of the components, the most alike first, by rounds of best choices."""
    label, keep = comp.copy(), []
    order = np.lexsort((b, a, -alike))
    while True:
        la, lb = label[a[order]], label[b[order]]
        order = order[la != lb]
        if not len(order):
            return np.unique(np.array(keep, np.int64))
        la, lb = label[a[order]], label[b[order]]
        _, first = np.unique(np.stack([la, lb], axis=1).ravel(), return_index=True)  # each component's best pair, ties in one order for all
        chosen = np.unique(order[first // 2])
        keep += chosen.tolist()
        root = {int(x): int(x) for x in np.unique(label)}

        def find(x: int, root: dict[int, int] = root) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for i in chosen:
            x, y = find(int(label[a[i]])), find(int(label[b[i]]))
            root[max(x, y)] = min(x, y)
        values, where = np.unique(label, return_inverse=True)
        label = np.array([find(int(v)) for v in values])[where]


class _Block:
    """The members of one block of a bucket, and the pairs between its components that sizes and sketches admit."""

    def __init__(self, group: pd.DataFrame, first_band_only: bool):
        self.group = group = group.drop_duplicates("id").sort_values("id")
        self.ids, self.comp = group["id"].to_numpy(), group["component"].to_numpy()
        n, half = group["n"].to_numpy(), group["chunk"].to_numpy()
        bits = np.frombuffer(b"".join(group["bits"]), np.uint8).reshape(len(group), COORDINATES)
        band = int(group["key"].iloc[0]) & BAND_MASK
        keys = np.stack(group["bands"].to_list()) if first_band_only and band else None
        values, sizes = np.unique(self.comp, return_counts=True)
        largest = values[np.argmax(sizes)]
        apart = group["low"].iloc[0] != group["high"].iloc[0]
        a, b, alike = [], [], []
        for i in np.flatnonzero(self.comp != largest):  # a pair of two outliers is met once, from its smaller id
            other = (self.comp != self.comp[i]) & (100 * np.minimum(n, n[i]) >= PERCENT * np.maximum(n, n[i]))
            other[:i] &= self.comp[:i] == largest
            if apart:
                other &= half != half[i]
            at = np.flatnonzero(other)
            if not len(at):
                continue
            equal = bits[at] == bits[i]
            same = equal.sum(axis=1)
            good = same >= AGREE
            if keys is not None:
                good[good] = ~(keys[at[good], :band] == keys[i, :band]).any(axis=1)
            a.append(np.full(good.sum(), i))
            b.append(at[good])
            alike.append(same[good])
        self.a, self.b, self.alike = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b, alike))

    def edges(self, own: np.ndarray) -> pd.DataFrame:
        x, y = self.ids[self.a[own]], self.ids[self.b[own]]
        return pd.DataFrame({"a": np.minimum(x, y).astype(np.int64), "b": np.maximum(x, y).astype(np.int64)})


def _spanning(group: pd.DataFrame) -> pd.DataFrame:
    block = _Block(group, first_band_only=False)
    return block.edges(_forest(block.comp, block.a, block.b, block.alike) if len(block.a) else np.zeros(0, np.int64))


def _involved(group: pd.DataFrame) -> pd.DataFrame:
    """Members of the block that have any pair to be looked at."""
    block = _Block(group, first_band_only=True)
    return block.group.iloc[np.unique(np.concatenate([block.a, block.b]).astype(np.int64))]


def _confirmed(group: pd.DataFrame) -> pd.DataFrame:
    """Links on full sets that connect the block's components, the most alike first; pairs already connected needn't be looked at."""
    block = _Block(group, first_band_only=True)
    sets = [np.frombuffer(e, np.uint64) for e in block.group["elements"]]
    label, keep = block.comp.copy(), []
    for k in np.lexsort((block.b, block.a, -block.alike)):
        i, j = block.a[k], block.b[k]
        if label[i] != label[j]:
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= PERCENT * (len(sets[i]) + len(sets[j]) - both):
                keep.append(k)
                label[label == label[j]] = label[i]
    return block.edges(np.array(keep, np.int64))


_BLOCK = ["key", "low", "high"]
_MEMBER = "key long, low int, high int, id long, component long, n long, chunk int, bits binary, bands array<long>"


def mixed_blocks(members: DataFrame, bits: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of the buckets that hold several components, cut into blocks, with the columns of ``bits``; ``members``: key, id, n. Every pair of a bucket shares a block."""
    labelled = members.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("key").agg(
        F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("size"),
        F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("i0"), F.max("id").alias("i1"),
    ).filter("c0 < c1")
    band = F.col("key").bitwiseAND(F.lit(BAND_MASK))
    # bands often agree on a bucket: the first one of them stands for all
    mixed = mixed.groupBy("m", "size", "x", "i0", "i1").agg(F.min(F.struct(band.alias("band"), "key")).alias("first"))
    chunks = F.ceil(F.greatest(F.col("m") / BLOCK_MEMBERS, F.col("size") / BLOCK_ELEMENTS)).cast("int")
    rows = labelled.join(mixed.select(F.col("first.key").alias("key"), chunks.alias("chunks")).hint("merge"), "key")
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).join(bits.hint("merge"), "id")
    rows = rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return rows.select("key", F.least("chunk", "with").alias("low"), F.greatest("chunk", "with").alias("high"), "id", "component", "n", "chunk", *[c for c in bits.columns if c != "id"])


def spanning_pairs(members: DataFrame, bits: DataFrame, comps: DataFrame) -> DataFrame:
    """Step 2: pairs (a, b) to verify."""
    return mixed_blocks(members, bits, comps).groupBy(*_BLOCK).applyInPandas(_spanning, "a long, b long").distinct()


def remaining_links(members: DataFrame, bits: DataFrame, comps: DataFrame, docs: DataFrame) -> DataFrame:
    """Step 3: links between components; ``bits`` has the keys of all bands too. Blocks are met by the full sets of just those members that have a pair left."""
    left = materialize(mixed_blocks(members, bits, comps).groupBy(*_BLOCK).applyInPandas(_involved, _MEMBER), "involved")
    whole = left.join(element_sets(left.select("id"), docs).hint("merge"), "id")
    return materialize(whole.groupBy(*_BLOCK).applyInPandas(_confirmed, "a long, b long"), "links")


def group(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Null text and text without words have an empty set and are linked with
    nothing; a text of one to four words is one shingle. Rows that share a
    doc_id are one vertex of the graph. A null doc_id can't stand for others:
    such rows get the component of the documents with the same set, if any.
    Very long texts are read whole. Empty tables give an empty one.
    """
    sketches = materialize(docs.select("doc_id", "text").mapInArrow(_sketches, "doc_id long, n_shingles long, set_key binary, bands array<long>, bits binary"), "sketches")
    rep = sketches.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("alike"))
    rep = materialize(rep, "classes")
    # nothing that grows with the data is broadcast here, whatever its size
    own = materialize(sketches.join(rep.select("set_key", F.col("rep").alias("doc_id")).hint("merge"), ["set_key", "doc_id"], "left_semi").drop("set_key"), "own")
    buckets = own.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    leaders = buckets.groupBy("key").agg(F.min(F.struct("id", "n")).alias("lead"), F.max("id").alias("last")).filter("lead.id < last").select("key", "lead")
    members = materialize(buckets.join(leaders.hint("merge"), "key"), "members")
    fits = F.least("n", "lead.n") * 100 >= F.greatest("n", "lead.n") * PERCENT
    star = materialize(members.filter((F.col("id") != F.col("lead.id")) & fits).select(F.col("lead.id").alias("a"), F.col("id").alias("b")).distinct(), "candidates")
    links = verify(star, docs)
    comps = components(links)
    members, bits = members.select("key", "id", "n"), own.select(F.col("doc_id").alias("id"), "bits", "bands")
    more = materialize(spanning_pairs(members, bits.drop("bands"), comps).join(star, ["a", "b"], "left_anti"), "candidates")
    links = links.unionByName(verify(more, docs))
    links = links.unionByName(remaining_links(members, bits, components(links), docs))
    comps = components(links)
    whole = rep.join(comps.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    # a class of one row that is linked with nothing answers for itself
    whole = whole.filter("alike > 1 or component_id != rep").select("set_key", "component_id")
    out = sketches.select("doc_id", "n_shingles", "set_key").join(whole, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; columns unchanged, whatever their names.

    Where several rows share the id that stays, one of them does. Rows without
    an id can't be told apart by it and stay, and so do null, empty and
    wordless texts. Very long texts are compared whole. An empty table gives an empty one.

    The texts that are shuffled are those of the documents that go or share an
    id, and 1 in 16 others; where more than SCREEN_KEYS documents go, all are.
    """
    ids = materialize(group(docs), "near_groups").filter("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    unsure = materialize(ids.filter("not stays or n > 1"), "unsure_ids")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id")
    rows = flagged(rows, "doc_id", unsure.select("doc_id"), "may")
    sure = rows.filter("not may or doc_id is null").select("row")
    judged = rows.filter("may and doc_id is not null").join(unsure.hint("merge"), "doc_id", "left")
    out = sure.unionByName(judged.filter("stays is null or (stays and n = 1)").select("row"))
    if not unsure.filter("stays and n > 1").isEmpty():
        out = out.unionByName(judged.filter("stays and n > 1").dropDuplicates(["doc_id"]).select("row"))
    return out.select([F.col("row").getField(c).alias(c) for c in docs.columns])
