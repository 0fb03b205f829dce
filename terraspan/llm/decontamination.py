"""Benchmark decontamination by SimHash windows and a multi-index of Hamming blocks.

Every benchmark item is compared with windows of its own length, in words, over
whole documents. A window's fingerprint (128-bit SimHash of its shingles, each
with a vote of the square root of its weight along Gaussian planes) is
looked up in tables keyed by 16-bit blocks: with radius 39 over 8 blocks, any
fingerprint within the radius differs in at most 4 bits in some block, and
all such values of each block are looked up, so none within the radius is
missed. Candidates are verified by the exact weighted similarity of their
five-word shingles. At a weighted similarity of 0.75 or more the vectors of square
roots have a cosine of 2 x 0.75 / 1.75 or more, whatever the weights, so a
bit differs with a chance of at most 0.172, and more than 39 of 128 do with one
of 8 in 100,000.

Windows that hold too little weight of benchmark shingles to reach the
similarity with any item of their length are skipped before they are
fingerprinted; that bound is exact.

Words are letters and digits in lower case, so case and punctuation don't matter.

Documents are read and cut into words once, however large the benchmark is: it is
dealt into blocks of BLOCK_ITEMS items that Spark broadcasts one by one, and each
worker holds READY of their indexes at a time.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections import OrderedDict, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLDEN, WordIds, blocks_for, mix64, shingle_hashes, values

SHINGLE = 5
SIMILARITY = 0.75
BITS, BLOCKS, RADIUS = 128, 8, 39
#: Items of a block of the benchmark, and the blocks' indexes that a worker holds.
BLOCK_ITEMS, READY = 20_000, 2
#: Bytes of text whose words are held while the blocks of a larger benchmark go by.
GROUP_BYTES = 16 << 20
#: The middles of 256 equal shares of the normal distribution, times 64.
_NORMAL = np.array([round(64 * NormalDist().inv_cdf((i + 0.5) / 256)) for i in range(256)], np.int64)
TOKEN = re.compile(r"[^\W_]+")
_FLIPS = np.array([sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in itertools.combinations(range(16), r)], np.uint16)


def words_of(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def planes(hashes: np.ndarray) -> np.ndarray:
    """A row of 128 whole numbers for each shingle, normally distributed by 256 levels."""
    with np.errstate(over="ignore"):
        parts = mix64(hashes[:, None] + np.arange(1, BITS // 8 + 1, dtype=np.uint64) * GOLDEN)
    return _NORMAL[parts.view(np.uint8)]


def votes_of(weights: np.ndarray) -> np.ndarray:
    """Square roots of weights in whole numbers, so that sums are the same in any order."""
    return np.maximum(1, np.rint(np.sqrt(weights) * 64)).astype(np.int64)


def fingerprints(hashes: np.ndarray, starts: np.ndarray, width: int, weight) -> np.ndarray:
    """SimHash of the windows of ``width`` shingles at ``starts`` (ascending), as rows of 8 blocks of 16 bits.

    A shingle's vote is the square root of its count times its weight. Windows
    without a repeated shingle share running sums; the others are summed one by one.
    """
    first, own = int(starts[0]), hashes[int(starts[0]) : int(starts[-1]) + width]
    starts = starts - first
    w = weight(own)
    turned = planes(own)
    sums = np.zeros((len(own) + 1, BITS), np.int64)
    np.cumsum(turned * votes_of(w)[:, None], axis=0, out=sums[1:])
    votes = sums[starts + width] - sums[starts]
    order = np.argsort(own, kind="stable")
    again = np.full(len(own), 2 * len(own))  # the next place of the same shingle
    same = own[order[1:]] == own[order[:-1]]
    again[order[:-1][same]] = order[1:][same]
    soonest = np.minimum.accumulate(again[::-1])[::-1]
    for i in np.flatnonzero(soonest[starts] < starts + width):
        _, at, count = np.unique(own[starts[i] : starts[i] + width], return_index=True, return_counts=True)
        at = at + starts[i]
        votes[i] = (turned[at] * votes_of(w[at] * count)[:, None]).sum(axis=0)
    return np.packbits(votes > 0, axis=1).view(np.uint16)


def weighted_similarity(a: np.ndarray, b: np.ndarray, weight) -> float:
    """Sum of the smaller weights over the sum of the larger ones; a shingle weighs its count times ``weight``."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    every = np.union1d(ua, ub)
    na, nb = np.zeros(len(every)), np.zeros(len(every))
    na[np.searchsorted(every, ua)] = ca
    nb[np.searchsorted(every, ub)] = cb
    w = weight(every)
    top = float((w * np.maximum(na, nb)).sum())
    return float((w * np.minimum(na, nb)).sum()) / top if top else 0.0


@dataclass
class Words:
    """A text as word hashes, with the hashes of its shingles, made once for all blocks."""

    ids: np.ndarray
    hashes: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, text: str | None, known: WordIds) -> Words:
        return cls(known.of(words_of(text or "")))

    def shingles(self, k: int) -> np.ndarray:
        if k not in self.hashes:
            self.hashes[k] = shingle_hashes(self.ids, k)
        return self.hashes[k]


@dataclass
class Index:
    """The items of one block. Built by each Python worker from (item_id, text) rows.

    ``total`` is the number of items of the whole benchmark, ``many`` and
    ``times`` the shingles (ascending) that several of those hold and in how many;
    without them the items are the whole benchmark.
    """

    items: list[tuple[int, str]]
    total: int | None = None
    many: np.ndarray | None = field(default=None, compare=False)
    times: np.ndarray | None = field(default=None, compare=False)
    ready: bool = field(default=False, compare=False)

    def build(self) -> None:
        self.words = WordIds()
        self.ids, self.shingles = [], []
        self.by_length: dict[int, list[int]] = defaultdict(list)
        for k, (_, text) in enumerate(self.items):
            ids = self._ids(words_of(text or ""))
            self.ids.append(ids)
            self.shingles.append(shingle_hashes(ids, SHINGLE))
            if len(ids):
                self.by_length[len(ids)].append(k)
        per_item = [np.unique(s) for s in self.shingles]
        flat = np.concatenate(per_item) if per_item else np.zeros(0, np.uint64)
        self.known, df = np.unique(flat, return_counts=True)
        if self.total is None:
            self.total, self.many, self.times = len(self.items), self.known[df > 1], df[df > 1]
        self.bits = np.zeros(1 << 22, bool)
        self.bits[self.known >> np.uint64(42)] = True
        heavy = [float(self.weight(s).sum()) for s in self.shingles]
        self.least = {n: min(heavy[k] for k in own) for n, own in self.by_length.items()}
        # known shingle -> lengths of the items that hold it
        pairs = np.unique(np.array([(at, len(self.ids[k])) for k, u in enumerate(per_item) for at in np.searchsorted(self.known, u)], np.int64).reshape(-1, 2), axis=0)
        self.lengths = pairs[:, 1]
        self.lengths_at = np.searchsorted(pairs[:, 0], np.arange(len(self.known) + 1))
        # 16-bit value of a block -> items, as offsets into an order, for each block
        self.length = np.array([len(i) for i in self.ids], np.int64)
        whole = np.flatnonzero(self.length)
        self.prints = np.zeros((len(self.ids), BLOCKS), np.uint16)
        for k in whole:
            self.prints[k] = fingerprints(self.shingles[k], np.zeros(1, np.int64), len(self.shingles[k]), self.weight)[0]
        self.order = [whole[np.argsort(self.prints[whole, b], kind="stable")] for b in range(BLOCKS)]
        self.offsets = [np.searchsorted(self.prints[self.order[b], b], np.arange((1 << 16) + 1)) for b in range(BLOCKS)]
        self.ready = True

    def _ids(self, words: list[str]) -> np.ndarray:
        return self.words.of(words)

    def weight(self, shingles: np.ndarray) -> np.ndarray:
        """ln(1 + items / items with the shingle); one that no item has weighs as one that a single item has."""
        at = np.minimum(np.searchsorted(self.many, shingles), max(0, len(self.many) - 1))
        df = np.where(self.many[at] == shingles, self.times[at], 1) if len(self.many) else np.ones(len(shingles))
        return np.log1p(self.total / df)

    def near(self, prints: np.ndarray, n: int) -> list[tuple[int, int]]:
        """(window, item) of all items of ``n`` words within the radius, by the block tables."""
        windows, items = [], []
        for b in range(BLOCKS):
            probe = (prints[:, b, None] ^ _FLIPS[None, :]).astype(np.int64)
            low, high = self.offsets[b][probe], self.offsets[b][probe + 1]
            w, f = np.nonzero(high > low)
            low, count = low[w, f], (high - low)[w, f]
            place = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            found = self.order[b][place]
            same = self.length[found] == n
            windows.append(np.repeat(w, count)[same])
            items.append(found[same])
        pairs = np.unique(np.stack([np.concatenate(windows), np.concatenate(items)], axis=1), axis=0)
        apart = np.bitwise_count(prints[pairs[:, 0]] ^ self.prints[pairs[:, 1]]).sum(axis=1, dtype=np.int64)
        return [(int(w), int(k)) for w, k in pairs[apart <= RADIUS]]

    def hits(self, hashes: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each item length, the places (ascending) and weights of shingles that items of that length hold."""
        may = np.flatnonzero(self.bits[hashes >> np.uint64(42)])
        if not len(may):
            return {}
        at = np.minimum(np.searchsorted(self.known, hashes[may]), len(self.known) - 1)
        sure = self.known[at] == hashes[may]
        may, at = may[sure], at[sure]
        count = self.lengths_at[at + 1] - self.lengths_at[at]
        place = np.repeat(self.lengths_at[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
        length, where, weight = self.lengths[place], np.repeat(may, count), np.repeat(self.weight(hashes[may]), count)
        return {int(n): (where[length == n], weight[length == n]) for n in np.unique(length)}

    def search(self, text: str | None) -> list[tuple[int, int, float]]:
        """(item_id, first word, similarity) of the best window for each item that the text holds."""
        return self.find(Words.of(text, WordIds()))

    def find(self, text: Words) -> list[tuple[int, int, float]]:
        if not self.ready:
            self.build()
        ids = text.ids
        if not len(ids) or not self.by_length:
            return []
        best: dict[int, tuple[float, int]] = {}
        for k in range(1, SHINGLE + 1):
            own = [n for n in self.by_length if min(n, SHINGLE) == k]
            if not own or len(ids) < k:
                continue
            hashes = text.shingles(k)
            for n, (where, weight) in self.hits(hashes).items():
                if min(n, SHINGLE) != k:
                    continue
                width = min(n, len(ids))
                sums = np.zeros(len(hashes) + 1)
                sums[where + 1] = weight
                np.cumsum(sums, out=sums)
                inside = sums[width - k + 1 :] - sums[: len(sums) - (width - k + 1)]
                starts = np.flatnonzero(inside >= self.least[n] * SIMILARITY * (1 - 1e-9))
                for block in (starts[i : i + 64] for i in range(0, len(starts), 64)):
                    for part in np.split(block, np.flatnonzero(np.diff(block) > 4 * width) + 1):
                        for w, item in self.near(fingerprints(hashes, part, width - k + 1, self.weight), n):
                            start = int(part[w])
                            s = weighted_similarity(hashes[start : start + width - k + 1], self.shingles[item], self.weight)
                            if s >= SIMILARITY and (item not in best or s > best[item][0] + 1e-12):
                                best[item] = (s, start)
        return sorted((self.items[i][0], start, s) for i, (s, start) in best.items())


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordIds()
    for batch in batches:
        own = [np.unique(shingle_hashes(words.of(words_of(t)), SHINGLE)) for t in values(batch.column(0))]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64))], names=["shingle"])


def repeated_shingles(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (ascending) that several of the items hold, and in how many. What one item holds weighs as what none does, so it isn't kept."""
    counted = rows.select("text").mapInArrow(_shingles, "shingle long").groupBy("shingle").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").toArrow()
    many, times = counted.column("shingle").to_numpy().view(np.uint64), counted.column("n").to_numpy()
    order = np.argsort(many)
    return many[order], times[order].astype(np.uint32)


#: This worker's indexes, the ones used last; they outlive a task.
_built: OrderedDict[str, Index] = OrderedDict()


@dataclass(frozen=True)
class Blocks:
    """The whole benchmark as broadcast blocks of items, and the broadcast weights where there are several blocks."""

    token: str
    items: tuple[Broadcast, ...]
    weights: Broadcast | None

    def index(self, k: int) -> Index:
        name = f"{self.token}/{k}"
        if name not in _built:
            index = Index(self.items[k].value, *(self.weights.value if self.weights else ()))
            index.build()
            while len(_built) >= READY:
                _built.popitem(last=False)
            _built[name] = index
        _built.move_to_end(name)
        return _built[name]

    def search(self, texts: Iterable[str | None], first_only: bool) -> Iterator[list[tuple[int, int, float]]]:
        """Of each text what ``Index.search`` tells, over all blocks; with ``first_only`` no more once a block has told something."""
        known = WordIds()
        if len(self.items) == 1:  # texts come and go one at a time
            index = self.index(0)
            for t in texts:
                yield index.find(Words.of(t, known))
            return
        held = [Words.of(t, known) for t in texts]
        found: list[list[tuple[int, int, float]]] = [[] for _ in held]
        for k in range(len(self.items)):
            index = self.index(k)
            for i, words in enumerate(held):
                if not (first_only and found[i]):
                    found[i] += index.find(words)
        yield from map(sorted, found)


def blocks_of(benchmark: DataFrame, per_block: int | None = None) -> Blocks:
    """The benchmark in blocks of about ``per_block`` items; the driver collects one block at a time and keeps none. Weights are those of the whole benchmark."""
    context = benchmark.sparkSession.sparkContext
    rows = benchmark.select("item_id", "text").filter("text is not null").distinct()
    n = rows.count()
    cut = blocks_for(n, per_block or BLOCK_ITEMS)

    def sent(value) -> Broadcast:
        out = context.broadcast(value)
        out.__dict__.pop("_value", None)  # it is on disk now, where executors fetch it
        return out

    items = []
    for p in range(cut):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(cut)) == p).orderBy("item_id", "text").collect()
        items.append(sent([(r["item_id"], r["text"]) for r in own]))
    return Blocks(uuid.uuid4().hex, tuple(items), sent((n, *repeated_shingles(rows))) if cut > 1 else None)


def grouped(batches: Iterator[pa.RecordBatch], several: bool) -> Iterator[pa.RecordBatch]:
    """Batches as they come, or, for several blocks, put together to about GROUP_BYTES, so that an index is fetched less often."""
    if not several:
        yield from batches
        return
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= GROUP_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_word, similarity): the best window of every document for every item it holds.

    Null and empty texts hold nothing, and items without words are in nothing.
    Items shorter than five words are one shingle and need their exact words.
    Documents shorter than an item are one window; very long ones are searched
    whole. Among equal windows the first counts; of several items that match,
    alike or not, each is told. Equal rows of the benchmark count as one item.
    Repeated documents give repeated results; other columns are ignored,
    whatever their names; an empty table on either side gives an empty one.
    """
    blocks = blocks_of(benchmark)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, len(blocks.items) > 1):
            found = blocks.search(values(batch.column(1)), first_only=False)
            rows = [(d, *x) for d, hits in zip(batch.column(0).to_pylist(), found, strict=True) for x in hits]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], names=["doc_id", "item_id", "first_word", "similarity"])

    return docs.select("doc_id", "text").mapInArrow(look, "doc_id long, item_id long, first_word int, similarity double")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item; columns unchanged, whatever their names, nothing shuffled.

    Null and empty texts hold nothing and stay; the rest as in ``contaminated``.
    """
    at, blocks = docs.columns.index("text"), blocks_of(benchmark)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, len(blocks.items) > 1):
            yield batch.filter(pa.array([not hits for hits in blocks.search(values(batch.column(at)), first_only=True)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
