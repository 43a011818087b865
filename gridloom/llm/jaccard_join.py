"""Exact Jaccard self-join of documents over word shingles, and the groups it links.

1. Documents with equal shingle sets become one node, named by the smallest id.
2. Set sizes fall into bands of ratio 1/threshold; two similar sets lie in the same band or in
   neighbours. For each band a set's hash range is cut into more segments than two similar sets of
   the band can differ in, so at least one segment is equal in both. A tile is one band, segment and
   segment content; sets that share no tile cannot be similar.
3. Every set of a tile is checked against the tile's hub. Links found make components; only sets of
   a tile that are still in different components are compared with each other, in blocks. There, a
   link joins two components at once and pairs within one are skipped, so that links, not pairs, come out.
4. A check bounds the overlap from above by the sizes and by hashed parity bitmaps (every differing
   shingle flips one bit, so differing bits never exceed differing shingles); what passes is decided
   by intersecting the sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import importable, stored
from gridloom.llm.components import component_labels

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SLICE = 256
# Sets of a tile in a block; sets, and bytes of their hashes, in a block of a group.
BLOCK, GROUP_BLOCK, BLOCK_BYTES = 1024, 4096, 1 << 25
# A shingle is frequent in a batch from this share of its rows on, and at least so many; the most
# frequent ones, a list of fixed size, are left out of tiles first. No link depends on the list.
OFTEN_SHARE, OFTEN_LEAST, OFTEN_SIZE = 0.005, 8, 50_000
HUB_ROUNDS = 2
# Ids are broadcast to filter documents up to this many (8 bytes each); beyond, they are joined.
BROADCAST_IDS = 1_000_000
_M = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M[0]
    x = (x ^ (x >> np.uint64(27))) * _M[1]
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: list[str | None], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each text, and where each text begins (one more at the end).

    Words are runs without ASCII white space, A-Z in lower case. Fewer than ``width`` words are one
    shingle, no word none.
    """
    words = [t.encode("utf-8").translate(LOWER).split() if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    digest = xxhash.xxh3_64_intdigest
    flat = np.fromiter((digest(w) for own in words for w in own), dtype=np.uint64, count=int(sizes.sum()))
    begins = np.concatenate(([0], np.cumsum(sizes)))
    owner, hashes = [], []
    n = len(flat) - width + 1
    if n > 0:
        value = np.zeros(n, dtype=np.uint64)
        for k in range(width):
            value = mixed(value + flat[k : k + n] * _M[k % 5] + np.uint64(k))
        doc = np.repeat(np.arange(len(texts)), sizes)
        inside = doc[:n] == doc[width - 1 :]
        owner.append(doc[:n][inside])
        hashes.append(value[inside])
    for d in np.flatnonzero((sizes > 0) & (sizes < width)):
        value = np.array([len(words[d])], dtype=np.uint64)
        for h in flat[begins[d] : begins[d + 1]]:
            value = mixed(value * _M[2] + h)
        owner.append(np.array([d]))
        hashes.append(value)
    owner = np.concatenate(owner) if owner else np.zeros(0, dtype=np.int64)
    hashes = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    if len(owner):
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])))
        owner, hashes = owner[new], hashes[new]
    return hashes, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts))))).astype(np.int64)


class Bands:
    """Size bands for a threshold of ``percent``: lower ends, segments and spare segments of each tag.

    Tag ``j`` joins the bands ``j - 1`` and ``j``. Segments of no or one shingle say little: many sets
    share them. With ``spare`` segments more than differences plus one, a set with no more than
    ``spare`` of those still shares a richer one, so only sets with more of them need them as tiles.
    """

    def __init__(self, percent: int):
        self.percent = percent
        self.low, self.segments, self.spare = [0, 1], [1, 1], [0, 0]

    def upto(self, size: int) -> "Bands":
        while self.low[-1] <= size or len(self.low) < 4:
            band = len(self.low) - 1
            high = self.low[band] * 100 // self.percent
            differences = 2 * high * (100 - self.percent) // (100 + self.percent)
            least = self.low[band - 1] if band > 1 else 1
            mean = least / (differences + 1)
            spare = 1 + int(1.5 * (differences + 1) * (1 + mean) * np.exp(-mean)) if differences else 0
            self.segments[band], self.spare[band] = differences + 1 + spare, spare
            self.low.append(high + 1)
            self.segments.append(1)
            self.spare.append(0)
        return self


def _tag_tiles(
    hashes: np.ndarray, element: np.ndarray, n_texts: int, tag: np.ndarray, count: np.ndarray, spare: np.ndarray, poor_size: int, complete: bool, salt: int
) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Tiles of one tag per text, and which texts have more poor segments than can be spared.

    Segments of up to ``poor_size`` shingles are poor. They are tiles only of those texts, and only if
    the list is to be ``complete``.
    """
    segment = ((hashes >> np.uint64(32)) * count[element].astype(np.uint64)) >> np.uint64(32)
    name = mixed(tag.astype(np.uint64) * _M[4] + np.uint64(salt))
    if len(element):
        first = np.flatnonzero(np.concatenate(([True], (element[1:] != element[:-1]) | (segment[1:] != segment[:-1]))))
        total = np.add.reduceat(mixed(hashes + _M[3]), first)
    else:
        first, total = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    own = element[first]
    rich = np.diff(np.append(first, len(element))) > poor_size
    poor = count - np.bincount(own[rich], minlength=n_texts) > spare
    used = rich | (poor[own] if complete else False)
    keys, owners = [mixed(total + mixed(name[own] + segment[first]))[used]], [own[used]]
    if complete:
        filled = np.bincount(own, minlength=n_texts)
        for d in np.flatnonzero(poor & (filled > 0) & (count > filled)):
            empty = np.setdiff1d(np.arange(count[d], dtype=np.uint64), segment[element == d])
            keys.append(mixed(mixed(name[d] + empty)))
            owners.append(np.full(len(empty), d))
    return keys, owners, poor


def tile_rows(hashes: np.ndarray, begins: np.ndarray, bands: Bands, often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Tile keys of all texts of a slice, and the text each belongs to.

    Shingles in ``often`` (sorted) are left out first: without them two similar sets differ in no more
    shingles than with them, so they still share a filled segment unless both have too many empty
    ones. Only such texts, which consist mostly of frequent shingles, have tiles over all shingles too.
    """
    sizes = np.diff(begins)
    bands.upto(int(sizes.max(initial=1)) * 2 + 2)
    low, segments, spare = np.array(bands.low), np.array(bands.segments), np.array(bands.spare)
    band = np.searchsorted(low, sizes, side="right") - 1
    element = np.repeat(np.arange(len(sizes)), sizes)
    keys, owners = [], []
    for tag in (band, band + 1):
        rest = np.ones(len(element), dtype=bool)
        if often is not None and len(often):
            at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
            rare = often[at] != hashes
            k, o, poor = _tag_tiles(hashes[rare], element[rare], len(sizes), tag, segments[tag], spare[tag], 0, False, 1)
            keys, owners, rest = keys + k, owners + o, poor[element]
        k, o, _ = _tag_tiles(hashes[rest], element[rest], len(sizes), tag, segments[tag], spare[tag], 1, True, 0)
        keys, owners = keys + k, owners + o
    return np.concatenate(keys).view(np.int64), np.concatenate(owners)


def parity_bitmap(hashes: np.ndarray) -> bytes:
    """One bit per residue, flipped by each shingle; a power of two of at least as many bits as shingles, 512 at least.

    So many that two unrelated sets of any size differ in more bits than a link of 80 percent allows.
    """
    bits = max(512, 1 << max(len(hashes) - 1, 0).bit_length())
    return np.packbits((np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bitmap: bytes, size: int) -> np.ndarray:
    """A bitmap of ``size`` bytes; halves of a longer one are combined, which keeps the bound."""
    return np.bitwise_xor.reduce(np.frombuffer(bitmap, dtype=np.uint8).reshape(-1, size), axis=0)


def may_link(a: bytes, b: bytes, n_a: int, n_b: int, percent: int) -> bool:
    """Whether sizes and bitmaps leave room for the overlap that a link needs."""
    if 100 * min(n_a, n_b) < percent * max(n_a, n_b):
        return False
    size = min(len(a), len(b))
    differ = int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())
    return (100 + percent) * differ <= (n_a + n_b) * (100 - percent)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or with so many underscores before it that ``df`` has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = "_" + name
    return name


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    name = fresh(docs, "only")
    keys = ids.select(F.col(ids.columns[0]).alias(name)).distinct()
    few = keys.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(keys) if few else keys, F.col("doc_id") == F.col(name), how)


def frequent(hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in a good share of the rows of a batch, and in how many."""
    values, counts = np.unique(hashes, return_counts=True)
    many = counts >= max(OFTEN_LEAST, OFTEN_SHARE * rows)
    return values[many], counts[many]


def _slices(batches: Iterator[pa.RecordBatch], width: int):
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            part = batch.slice(i, SLICE)
            yield part.column(0), *shingle_sets(part.column(1).to_pylist(), width)


def set_summaries(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, digest`` of each row; the first row of a batch has its frequent shingles too."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = list(_slices([batch], width))
            for i, (ids, hashes, begins) in enumerate(parts):
                digests = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) for a, b in zip(begins, begins[1:])]
                often, counts = frequent(np.concatenate([h for _, h, _ in parts]), batch.num_rows) if i == 0 else ([], [])
                first = lambda values: pa.array([values, *[[]] * (len(ids) - 1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(begins), pa.int64()), pa.array(digests, pa.binary()), first(np.asarray(often, dtype=np.uint64).view(np.int64)), first(np.asarray(counts, dtype=np.int64))],
                    names=["doc_id", "n_shingles", "digest", "often", "counts"],
                )

    importable(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(summarise, "doc_id long, n_shingles long, digest binary, often array<long>, counts array<long>")


def often_list(summaries: DataFrame) -> np.ndarray:
    """The most frequent shingles over all batches, sorted; at most ``OFTEN_SIZE`` numbers reach the driver."""
    each = summaries.where(F.size("often") > 0).select(F.inline(F.arrays_zip("often", "counts")))
    top = each.groupBy("often").agg(F.sum("counts").alias("n")).orderBy(F.desc("n"), "often").limit(OFTEN_SIZE)
    return np.sort(np.array([r["often"] for r in top.collect()], dtype=np.int64).view(np.uint64))


def tile_members(docs: DataFrame, width: int, percent: int, often: np.ndarray) -> DataFrame:
    """``key, node`` of every tile with two nodes or more."""
    shared = docs.sparkSession.sparkContext.broadcast(often)

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for ids, hashes, begins in _slices(batches, width):
            keys, owners = tile_rows(hashes, begins, bands, shared.value)
            yield pa.RecordBatch.from_arrays([pa.array(keys), ids.take(pa.array(owners))], names=["key", "node"])

    rows = docs.select("doc_id", "text").mapInArrow(tiles, "key long, node long")
    tile = Window.partitionBy("key")
    return rows.withColumns({"lo": F.min("node").over(tile), "hi": F.max("node").over(tile)}).where("lo < hi").select("key", "node").distinct()


def set_cards(docs: DataFrame, width: int) -> DataFrame:
    """``node, n, bitmap, hashes`` of each row."""

    def cards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, begins in _slices(batches, width):
            own = [hashes[a:b] for a, b in zip(begins, begins[1:])]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.diff(begins), pa.int64()), pa.array([parity_bitmap(h) for h in own], pa.binary()), pa.array([h.tobytes() for h in own], pa.binary())],
                names=["node", "n", "bitmap", "hashes"],
            )

    return docs.select("doc_id", "text").mapInArrow(cards, "node long, n long, bitmap binary, hashes binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted arrays without repeats link."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _of(cards: DataFrame, side: str, columns: list[str]) -> DataFrame:
    return cards.select(F.col("node").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns])


def verified(pairs: DataFrame, cards: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` of nodes that link: the bound first, the sorted arrays for what passes."""

    def room(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            keep = [may_link(*v, percent) for v in zip(p["bitmap_a"], p["bitmap_b"], p["n_a"], p["n_b"])]
            yield p.loc[np.array(keep, dtype=bool), ["a", "b"]]

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            keep = [similar(np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64), percent) for x, y in zip(p["hashes_a"], p["hashes_b"])]
            yield p.loc[np.array(keep, dtype=bool), ["a", "b"]]

    light = ["n", "bitmap"]
    pairs = pairs.join(_of(cards, "a", light), "a").join(_of(cards, "b", light), "b").mapInPandas(room, "a long, b long")
    pairs = stored(pairs, "bounded-pairs")
    return pairs.join(_of(cards, "a", ["hashes"]), "a").join(_of(cards, "b", ["hashes"]), "b").mapInPandas(exact, "a long, b long")


def _hub_pairs(members: DataFrame, seed: int) -> DataFrame:
    """Distinct ``(a, b)`` with one end a tile's hub, the node of the least hash."""
    rank = F.struct(F.xxhash64("node", F.lit(seed)).alias("h"), F.col("node"))
    hubs = members.groupBy("key").agg(F.min(rank).alias("hub")).select("key", F.col("hub.node").alias("hub"))
    both = members.join(hubs, "key").where("node != hub")
    return both.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, node, comp, m`` of tiles that hold different components; ``m`` counts the tile's nodes."""
    labelled = members.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    tiles = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"))
    return labelled.join(tiles.where("lo < hi").select("key", "m"), "key")


def _near_steps(n: np.ndarray, maps: np.ndarray, part: np.ndarray, mine: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one ``part`` that sizes and bitmaps allow, one distance between the two at a time.

    Rows of a part lie together; ``mine`` tells the two sides of a part that joins two blocks (-1 where
    any two rows may meet).
    """
    i, step = np.arange(len(n) - 1), 1
    while len(i):
        i = i[i + step < len(n)]
        i = i[part[i] == part[i + step]]
        j = i + step
        fit = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & ((mine[i] < 0) | (mine[i] != mine[j]))
        x, y = i[fit], j[fit]
        differ = np.bitwise_count(maps[x] ^ maps[y]).sum(axis=1, dtype=np.int64)
        near = (100 + percent) * differ <= (n[x] + n[y]) * (100 - percent)
        yield x[near], y[near]
        step += 1


def _in_blocks(rows: DataFrame, blocks: Column) -> DataFrame:
    """Rows with ``node`` once for each pair of blocks they are in: ``lo, hi``, and the own block, ``mine``."""
    spread = rows.withColumn("blocks", F.greatest(blocks, F.lit(1)).cast("int")).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return spread.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")}).drop("blocks", "other")


def _near_edges(open_rows: DataFrame, cards: DataFrame, percent: int) -> DataFrame:
    """``(a, b)``: nodes of different components that the bound lets meet in a tile; not all pairs, but the same groups as all would make."""
    rows = _in_blocks(open_rows, F.ceil(F.col("m") / BLOCK)).join(cards.select("node", "n", "bitmap"), "node").select("key", "lo", "hi", "mine", "node", "comp", "n", "bitmap")

    def meeting(batch: pd.DataFrame, part: np.ndarray) -> pd.DataFrame:
        node, comp, n, mine, lo, hi = (batch[c].to_numpy() for c in ("node", "comp", "n", "mine", "lo", "hi"))
        side, bitmaps = np.where(lo == hi, -1, mine), batch["bitmap"].to_numpy()
        root, edges = np.arange(len(node)), []
        # A tile holds sets of about one size: parts of one length at a time, as short bitmaps tell long sets not apart.
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        length = np.repeat(np.minimum.reduceat([len(b) for b in bitmaps], starts), np.diff(np.append(starts, len(part))))
        for size in np.unique(length):
            own = np.flatnonzero(length == size)
            maps = np.stack([folded(b, size).view(np.uint64) for b in bitmaps[own]])
            for x, y in _near_steps(n[own], maps, part[own], side[own], percent):
                x, y = own[x], own[y]
                new = (comp[x] != comp[y]) & (root[x] != root[y])
                for i, j in zip(x[new].tolist(), y[new].tolist()):
                    if root[i] != root[j]:
                        root[root == root[j]] = root[i]
                        edges.append((node[i], node[j]))
        return pd.DataFrame(edges, columns=["a", "b"], dtype="int64").drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            batch = batch if held is None else pd.concat([held, batch], ignore_index=True)
            marks = batch[["key", "lo", "hi"]].to_numpy()
            group = np.concatenate(([0], np.cumsum((marks[1:] != marks[:-1]).any(axis=1))))[: len(batch)]
            # The last group may go on in the next batch.
            whole = int(np.searchsorted(group, group[-1])) if len(group) else 0
            held = batch.iloc[whole:]
            if whole:
                yield meeting(batch.iloc[:whole], group[:whole])
        if held is not None and len(held):
            yield meeting(held, np.zeros(len(held), dtype=np.int64))

    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInPandas(run, "a long, b long").distinct()


def joined_components(node: np.ndarray, comp: np.ndarray, mine: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the components of a group of sets as all links would: fewer than there are rows.

    Pairs within one component are skipped, others bounded by bitmaps eight times as long as the sets.
    """
    n = np.array([len(s) for s in sets], dtype=np.int64)
    bits = 8 << max(int(n.max(initial=1)) - 1, 63).bit_length()
    maps = np.zeros((len(sets), bits // 64), dtype=np.uint64)
    for i, own in enumerate(sets):
        maps[i] = np.packbits((np.bincount((own % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)
    names, of_row = np.unique(comp, return_inverse=True)
    root, links = np.arange(len(names)), []
    for x, y in _near_steps(n, maps, np.zeros(len(node), dtype=np.int64), mine, percent):
        apart = root[of_row[x]] != root[of_row[y]]
        for i, j in zip(x[apart].tolist(), y[apart].tolist()):
            a, b = root[of_row[i]], root[of_row[j]]
            if a != b and similar(sets[i], sets[j], percent):
                root[root == b] = a
                links.append((int(min(node[i], node[j])), int(max(node[i], node[j]))))
    return links


def _group_links(groups: DataFrame, labels: DataFrame, cards: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` that join the components (``labels``) within each group of ``groups (node, comp)``; a set is sent once for each block."""
    members = groups.withColumnRenamed("comp", "key").join(cards.select("node", "n"), "node")
    sized = members.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("total"))
    blocks = F.greatest(F.ceil(F.col("m") / GROUP_BLOCK), F.ceil(F.col("total") * 8 / BLOCK_BYTES))
    spread = _in_blocks(members.select("key", "node").join(sized, "key"), blocks).drop("m", "total").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def verify(part: pd.DataFrame) -> pd.DataFrame:
        side = np.where(part["lo"] == part["hi"], -1, part["mine"])
        sets = [np.frombuffer(h, dtype=np.uint64) for h in part["hashes"]]
        return pd.DataFrame(joined_components(part["node"].to_numpy(), part["comp"].to_numpy(), side, sets, percent), columns=["a", "b"], dtype="int64")

    return spread.join(cards.select("node", "hashes"), "node").groupBy("key", "lo", "hi").applyInPandas(verify, "a long, b long").distinct()


def _sets_apart(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``node, doc_id, digest, text``: one row for each set of the ids that have several (``doc_id, least``), and of rows without id.

    The set of the least digest keeps its id as node; the others get numbers beyond all ids.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                hashes, begins = shingle_sets(part.column(1).to_pylist(), width)
                names = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) if a < b else None for a, b in zip(begins, begins[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.binary())], names=["doc_id", "text", "digest"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    known = ids.select(F.col("doc_id").alias("k"), "least")
    several = rows.join(known, F.col("doc_id") == F.col("k"), "left").where("k IS NOT NULL OR doc_id IS NULL").select("doc_id", "text")
    each = several.mapInArrow(digests, "doc_id long, text string, digest binary").where("digest IS NOT NULL").dropDuplicates(["doc_id", "digest"])
    top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    numbered = each.join(known, F.col("doc_id") == F.col("k"), "left")
    node = F.when(F.col("digest") == F.col("least"), F.col("doc_id")).otherwise(F.monotonically_increasing_id() + F.lit(top + 1))
    return stored(numbered.select(node.alias("node"), "doc_id", "digest", "text"), "sets-apart")


def _links(docs: DataFrame, summaries: DataFrame, width: int, percent: int) -> DataFrame:
    """``(a, b)``: links whose components are those of all links. ``docs`` has one set for each id."""
    spark = docs.sparkSession
    filled = summaries.where("n_shingles > 0")
    classes = stored(filled.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "set-classes")
    copies = stored(filled.join(classes, "digest").where("doc_id != rep").select("doc_id", "rep"), "set-copies")
    distinct = _only(docs, copies.select("doc_id"), "left_anti")
    members = stored(tile_members(distinct, width, percent, often_list(summaries)), "tile-members")
    nodes = members.select("node").distinct()
    cards = set_cards(_only(docs, nodes, "left_semi"), width)
    if not filled.groupBy("doc_id").count().where("count > 1").isEmpty():
        cards = cards.dropDuplicates(["node"])  # equal sets of one id; else the sets need no shuffle
    cards = stored(cards, "set-cards")

    links = spark.createDataFrame([], "a long, b long")
    checked = links
    open_rows = members
    for seed in range(HUB_ROUNDS):
        pairs = _hub_pairs(open_rows, seed).join(checked, ["a", "b"], "left_anti") if seed else _hub_pairs(open_rows, seed)
        pairs = stored(pairs, "hub-pairs")
        checked = checked.unionByName(pairs)
        links = links.unionByName(stored(verified(pairs, cards, percent), "hub-links"))
        labels = component_labels(links)
        # A tile in one component stays in one.
        open_rows = stored(_open_members(open_rows.select("key", "node"), labels), "open-tiles")
    # Nodes that may still link, in groups that no such pair leaves.
    groups = component_labels(stored(_near_edges(open_rows, cards, percent), "near-edges"))
    links = links.unionByName(stored(_group_links(groups, labels, cards, percent), "group-links"))
    return links.unionByName(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))


def linked_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``.

    Two documents link when ``100 * intersection >= percent * union`` of their shingle sets;
    ``component_id`` is the smallest id reachable by links. Texts without words (NULL too) have no
    shingles and link with nothing. Rows that share an id are one document with as many sets: it has the
    links of each. A row without an id links as others do and has a NULL component if only rows without
    an id can be reached. An empty table gives an empty result; other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    summaries = stored(set_summaries(docs, width), "set-summaries")
    filled = summaries.where("n_shingles > 0")
    several = filled.groupBy("doc_id").agg(F.min("digest").alias("least"), F.max("digest").alias("greatest")).where("doc_id IS NULL OR least < greatest")
    several = stored(several.select("doc_id", "least"), "ids-of-several-sets")
    if several.isEmpty():
        labels = component_labels(_links(docs, summaries, width, percent))
        return summaries.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))
    several = several.where("doc_id IS NOT NULL")
    apart = _sets_apart(docs, several, width)
    one_each = _only(docs.where("doc_id IS NOT NULL"), several, "left_anti").unionByName(apart.select(F.col("node").alias("doc_id"), "text"))
    one_each = stored(one_each, "one-set-each")
    links = _links(one_each, stored(set_summaries(one_each, width), "set-summaries"), width, percent)
    own = apart.where("doc_id IS NOT NULL AND node != doc_id").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    labels = stored(component_labels(links.unionByName(own)), "set-labels")
    # Numbers beyond all ids are the labels of groups without an id.
    top = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
    with_id = summaries.where("doc_id IS NOT NULL").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    nameless = apart.where("doc_id IS NULL").join(labels, "node").where(F.col("comp") <= top).select("digest", "comp")
    without = summaries.where("doc_id IS NULL").join(nameless, "digest", "left")
    both = with_id.select("doc_id", "n_shingles", F.coalesce("comp", "doc_id").alias("component_id"))
    return both.unionByName(without.select("doc_id", "n_shingles", F.col("comp").alias("component_id")))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs``, with all its columns, for each group of ``linked_groups``: one of the smallest id.

    Rows that share an id are one document, of which the row of the least text stays (NULL first; equal texts
    by a hash of all columns). Of rows without an id, equal texts stay once, NULL being one; links between
    different texts without an id are not looked at. Texts without words stay once for each id.
    """
    groups = stored(linked_groups(docs.where("doc_id IS NOT NULL"), width, percent), "near-groups")
    gone = groups.where("component_id < doc_id").select("doc_id")
    kept = _only(docs.where("doc_id IS NOT NULL"), gone, "left_anti")
    repeated = stored(groups.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated-ids")
    nameless = docs.where("doc_id IS NULL")
    parts = [kept]
    if not repeated.isEmpty():
        parts = [_only(kept, repeated, "left_anti"), _least_row(_only(kept, repeated, "left_semi"), "doc_id")]
    if not nameless.isEmpty():
        parts.append(_least_row(nameless, "text"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _least_row(docs: DataFrame, key: str) -> DataFrame:
    """One row per value of ``key``: that of the least text, then hash."""
    row, name = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), fresh(docs, "row")
    order = F.struct(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNotNull(), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return docs.groupBy(F.col(key).alias(fresh(docs, "key"))).agg(F.min_by(row, order).alias(name)).select(f"{name}.*")
