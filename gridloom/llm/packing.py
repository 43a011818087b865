"""Packing of documents into sequences by cutting-stock column generation.

1. Texts become ids. What of a document exceeds whole sequences (all of it, mostly) is a rest; whole
   sequences of long documents stand for themselves.
2. Rests are counted by length, in steps of ``unit`` ids rounded up. A linear program over patterns
   (numbers of rests of each length that fit a sequence) covers the counts with the fewest sequences.
   New patterns are priced by a knapsack over the program's dual values, until none is worth its place.
3. The program's numbers are rounded to whole sequences; rests of a length are ranked, and ranges of ranks
   go to the patterns. Rests no pattern takes, and those of as many sequences as it needs, are cut to fill
   the gaps that lengths leave. What remains of them is laid end to end into whole sequences, and the last
   ids into sequences whose lengths are powers of two, which need no padding either.

Only the counts by length, of which there are ``capacity / unit``, and totals reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import attach, importable, stored
from gridloom.llm.token_files import encoder, text_slices

ENCODED = "row long, part int, doc_id long, n long, bucket int, nth long, fulls long, ids binary"
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
# Sequences whose gaps are added up in one group, and ids in a cell where gaps meet what fills them.
BLOCK, CELL = 4096, 4096


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The greatest value of items (any number of each) that fit, and how many of each."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    useful = np.flatnonzero(values > 0)
    order = useful[np.argsort(sizes[useful], kind="stable")]
    fits = np.searchsorted(sizes[order], np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        items = order[: fits[c]]
        if len(items):
            worth = best[c - sizes[items]] + values[items]
            k = int(worth.argmax())
            if worth[k] > best[c] + 1e-12:
                best[c], taken[c] = worth[k], items[k]
    counts, c = np.zeros(len(sizes), dtype=np.int64), capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            counts[taken[c]] += 1
            c -= int(sizes[taken[c]])
    return float(best[capacity]), counts


def inverted(a: np.ndarray) -> np.ndarray:
    """The inverse by Gauss-Jordan steps in this thread."""
    n = len(a)
    both = np.hstack((a, np.eye(n)))
    for i in range(n):
        pivot = i + int(np.abs(both[i:, i]).argmax())
        both[[i, pivot]] = both[[pivot, i]]
        both[i] /= both[i, i]
        column = both[:, i].copy()
        column[i] = 0
        both -= np.outer(column, both[i])
    return both[:, n:]


def column_generation(
    sizes: np.ndarray, demand: np.ndarray, capacity: int, near: float = 1e-3, rounds: int = 5000
) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, whole or not, so that ``demand`` is met by few.

    A revised simplex method: it starts from patterns of one size each and swaps in the pattern that the
    knapsack finds. The number used divided by the knapsack's value is a lower bound for any cover, so the
    swaps end once the best bound is within ``near`` of the number; any stop leaves a valid cover.
    """
    # Slightly uneven demands, so that no two patterns run out at once and swaps do not go in circles.
    uneven = demand + (1 + np.arange(len(demand)) * 0.618034 % 1) * 1e-4
    patterns = np.diag(capacity // sizes).astype(np.float64)
    inverse = np.diag(1 / np.diag(patterns))
    bound = 0.0
    for step in range(rounds):
        value, counts = knapsack(inverse.sum(axis=1), sizes, capacity)
        used, direction = uneven @ inverse, counts @ inverse
        bound = max(bound, used.sum() / value)
        if used.sum() <= bound * (1 + near) or value <= 1 + 1e-9:
            break
        ratio = np.full(len(sizes), np.inf)
        rising = direction > 1e-9
        ratio[rising] = np.maximum(used[rising], 0) / direction[rising]
        out = int(ratio.argmin())
        patterns[out] = counts
        if step % 200 == 199:
            inverse = inverted(patterns)
        else:
            column = inverse[:, out] / direction[out]
            direction[out] -= 1
            inverse -= np.outer(column, direction)
    return patterns.astype(np.int64), np.maximum(demand @ inverted(patterns), 0)


def cutting_plan(histogram: dict[int, int], capacity: int, unit: int) -> list[tuple[dict[int, int], int]]:
    """Patterns as rests by bucket, and for how many sequences each stands.

    A bucket holds lengths of ``unit * (bucket - 1) + 1`` to ``unit * bucket``. No pattern takes more of a
    bucket than there is; the rests left are enough, whatever their exact lengths, to fill all gaps.
    """
    sizes = np.array(sorted(b for b, n in histogram.items() if n > 0), dtype=np.int64)
    if not len(sizes):
        return []
    left = np.array([histogram[b] for b in sizes], dtype=np.int64)
    room = capacity // unit
    patterns, used = column_generation(sizes, left.astype(np.float64), room)
    counts = np.floor(used + 1e-9).astype(np.int64)
    for i in range(len(patterns)):
        # Rounding may take one too many of a size that the program meets exactly.
        most = left[patterns[i] > 0] // patterns[i][patterns[i] > 0]
        counts[i] = min(int(counts[i]), int(most.min()))
        left -= counts[i] * patterns[i]
    for i in np.argsort(np.floor(used) - used, kind="stable"):
        if used[i] % 1 > 1e-6 and (patterns[i] <= left).all():
            counts[i] += 1
            left -= patterns[i]
    # The least a pattern's rests may hold, and so the most its gap may take.
    shortest = unit * (sizes - 1) + 1
    volume = patterns @ shortest
    gap, spare = int(((capacity - volume) * counts).sum()), int((left * shortest).sum())
    for i in np.argsort(patterns @ sizes, kind="stable"):
        if spare >= gap:
            break
        t = min(int(counts[i]), -(-(gap - spare) // capacity))
        counts[i] -= t
        gap, spare = gap - t * int(capacity - volume[i]), spare + t * int(volume[i])
    return [({int(b): int(a) for b, a in zip(sizes, p) if a}, int(n)) for p, n in zip(patterns, counts) if n]


def encoded(docs: DataFrame, vocabulary: str, capacity: int, unit: int, end_id: int) -> DataFrame:
    """``ENCODED``: ids of each document, and its number within its task, overall and in its bucket."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = encoder(vocabulary), TaskContext.get().partitionId()
        narrow = "<u2" if max(own.n_ids, end_id + 1) <= 1 << 16 else "<u4"
        row, fulls, seen = part << 40, 0, np.zeros(capacity // unit + 2, dtype=np.int64)
        for batch in batches:
            for first, texts in text_slices(batch.column(1)):
                ids, begins = own.flat(texts)
                ids = np.insert(ids, begins[1:], end_id).astype(narrow)
                n = np.diff(begins) + 1
                bucket = -(-(n % capacity) // unit)
                order = np.argsort(bucket, kind="stable")
                start = np.searchsorted(bucket[order], np.arange(len(seen)))
                nth = np.empty(len(n), dtype=np.int64)
                nth[order] = np.arange(len(n)) - start[bucket[order]] + seen[bucket[order]]
                seen += np.bincount(bucket, minlength=len(seen))
                whole = n // capacity
                offsets = np.concatenate(([0], np.cumsum(n))) * ids.itemsize
                binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(len(n))), pa.array(np.full(len(n), part, dtype=np.int32)), batch.column(0).slice(first, len(n)), pa.array(n),
                     pa.array(bucket.astype(np.int32)), pa.array(nth), pa.array(fulls + np.cumsum(whole) - whole), binary.cast(pa.binary())],
                    names=[f.split(" ")[0] for f in ENCODED.split(", ")],
                )
                row, fulls = row + len(n), fulls + int(whole.sum())

    importable(docs.sparkSession)
    return docs.mapInArrow(encode, ENCODED)


def placed_before(df: DataFrame, block: str, order: str, size: str) -> DataFrame:
    """Adds ``at``: the sum of ``size`` over all rows of earlier blocks, and of this block's earlier rows."""
    totals = df.groupBy(block).agg(F.sum(size).alias("_total"))
    # One row per block.
    earlier = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(block, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    within = Window.partitionBy(block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = df.withColumn("_running", F.coalesce(F.sum(size).over(within), F.lit(0)))
    return attach(running, bases, [block]).withColumn("at", F.col("_base") + F.col("_running")).drop("_base", "_running")


def _fills(fillers: DataFrame, gaps: DataFrame, gap: int, filler: int) -> DataFrame:
    """Pieces of fillers in gaps: both are laid end to end, and where two overlap is a piece."""

    def celled(df: DataFrame, size: str, upto: int) -> DataFrame:
        end = F.least(F.col("at") + F.col(size), F.lit(upto))
        own = df.where(F.col("at") < upto).withColumn("end", end)
        return own.withColumn("cell", F.explode(F.expr(f"sequence(at div {CELL}, (end - 1) div {CELL})")))

    f = celled(fillers, "rest", gap).select("cell", "row", "start", F.col("at").alias("f_at"), F.col("end").alias("f_end"))
    g = celled(gaps, "gap", filler).select("cell", "sequence_id", "used", F.col("at").alias("g_at"), F.col("end").alias("g_end"))
    both = f.join(g, "cell").withColumns({"lo": F.greatest("f_at", "g_at"), "hi": F.least("f_end", "g_end")})
    return both.where(f"lo < hi AND lo div {CELL} = cell").select(
        "row", (F.col("start") + F.col("lo") - F.col("f_at")).alias("start"), (F.col("hi") - F.col("lo")).alias("length"),
        "sequence_id", (F.col("used") + F.col("lo") - F.col("g_at")).alias("offset"),
    )


def _tail(rest: int) -> list[tuple[int, int]]:
    """Where sequences of the powers of two that add up to ``rest`` begin and end, the greatest first."""
    out, at = [], 0
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            out.append((at, at + (1 << bit)))
            at += 1 << bit
    return out


def _end_to_end(fillers: DataFrame, gap: int, filler: int, capacity: int, base: int) -> tuple[DataFrame, int]:
    """Pieces of what fillers have beyond the gaps, in sequences from ``base`` on, and how many of these there are."""
    whole, rest = divmod(max(filler - gap, 0), capacity)
    tail = [(whole * capacity + a, whole * capacity + b) for a, b in _tail(rest)]

    def slot(h: Column) -> Column:
        late = sum((F.when(h >= a, 1).otherwise(0) for a, _ in tail), F.lit(0)) - 1
        return F.when(h < whole * capacity, F.floor(h / capacity)).otherwise(F.lit(whole) + late).cast("long")

    def bound(i: int) -> Column:
        out = (F.col("slot") + i) * capacity
        for k, ends in enumerate(tail):
            out = F.when(F.col("slot") == whole + k, F.lit(ends[i])).otherwise(out)
        return out.cast("long")

    over = fillers.where(F.col("at") + F.col("rest") > gap).withColumns({
        "h0": F.greatest(F.col("at"), F.lit(gap)) - F.lit(gap), "h1": F.col("at") + F.col("rest") - F.lit(gap)})
    cut = over.withColumn("slot", F.explode(F.sequence(slot(F.col("h0")), slot(F.col("h1") - 1))))
    cut = cut.withColumns({"lo": F.greatest("h0", bound(0)), "hi": F.least("h1", bound(1))})
    pieces = cut.select(
        "row", (F.col("start") + F.col("lo") + F.lit(gap) - F.col("at")).alias("start"), (F.col("hi") - F.col("lo")).alias("length"),
        (F.col("slot") + F.lit(base)).alias("sequence_id"), (F.col("lo") - bound(0)).alias("offset"),
    )
    return pieces, whole + len(tail)


def _cut(joined: DataFrame, capacity: int) -> DataFrame:
    """``PIECES`` of documents with the places of their pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                n, ids = r["n"], r["ids"]
                width = len(ids) // n
                fulls = [(k * capacity, capacity, r["first_full"] + k, 0) for k in range(n // capacity)]
                for start, length, sequence, offset in fulls + [(p["start"], p["length"], p["sequence_id"], p["offset"]) for p in r["pieces"] or []]:
                    own = np.frombuffer(ids, dtype=f"<u{width}", count=length, offset=start * width).astype("<u4").tobytes()
                    for column, v in zip(columns, (r["doc_id"], start, length, own, n, sequence, offset)):
                        column.append(v)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = [f.split(" ")[0] for f in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return joined.select("doc_id", "n", "ids", "first_full", "pieces").mapInArrow(cut, PIECES)


def packed_sequences(
    docs: DataFrame, vocabulary: str, capacity: int = 2048, unit: int = 16, end_id: int = 1, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``; ids as little-endian 32-bit bytes.

    Every id of a document, ``end_id`` after it included, lies in exactly one piece; the pieces of a sequence
    follow each other from 0 without gaps and fill it up, or up to a power of two. NULL texts are empty (the
    end id alone). Rows that share an id are documents of their own, as are rows with a NULL id; texts of any
    length are cut into whole sequences and a rest. Other columns are not looked at. An empty table gives an
    empty result. ``unit`` has to divide ``capacity``, a power of two.
    """
    if capacity % unit or capacity & (capacity - 1):
        raise ValueError("capacity has to be a power of two and a multiple of the unit")
    spark = docs.sparkSession
    texts = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = stored(encoded(texts, vocabulary, capacity, unit, end_id), "packing-ids")
    narrow = rows.select("row", "part", "bucket", "nth", (F.col("n") % capacity).alias("rest"), F.expr(f"n - n % {capacity}").alias("start")).where("bucket > 0")

    # One row per length.
    histogram = {r["bucket"]: r["count"] for r in narrow.groupBy("bucket").count().collect()}
    ranges, taken, n_patterned = [], {}, 0
    for pattern, count in cutting_plan(histogram, capacity, unit):
        for bucket, copies in pattern.items():
            lo = taken.get(bucket, 0)
            taken[bucket] = lo + copies * count
            ranges.append((bucket, lo, taken[bucket], n_patterned, count))
        n_patterned += count
    ranges = spark.createDataFrame(ranges, "bucket int, lo long, hi long, first long, count long")

    # A rest's rank among those of its bucket: rests of earlier tasks, then earlier ones of its own.
    earlier = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = narrow.groupBy("part", "bucket").agg(F.count(F.lit(1)).alias("c")).select("part", "bucket", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("base"))
    ranked = attach(narrow, bases, ["part", "bucket"]).withColumn("rank", F.col("base") + F.col("nth"))
    # As many ranges as the plan's patterns have sizes: bounded by the number of lengths.
    found = ranked.join(F.broadcast(ranges.withColumnRenamed("bucket", "b")), F.expr("bucket = b AND lo <= rank AND rank < hi"), "left")
    placed = stored(found.select("row", "part", "rest", "start", F.expr("first + (rank - lo) % count").alias("sequence_id")), "packing-places")

    in_patterns, fillers = placed.where("sequence_id IS NOT NULL"), placed.where("sequence_id IS NULL")
    before = Window.partitionBy("sequence_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    whole = in_patterns.select("row", "start", F.col("rest").alias("length"), "sequence_id", F.coalesce(F.sum("rest").over(before), F.lit(0)).alias("offset"))
    gaps = in_patterns.groupBy("sequence_id").agg(F.sum("rest").alias("used")).withColumns({
        "gap": F.lit(capacity) - F.col("used"), "block": F.expr(f"sequence_id div {BLOCK}")}).where("gap > 0")
    gaps = stored(placed_before(gaps, "block", "sequence_id", "gap"), "packing-gaps")
    fillers = stored(placed_before(fillers, "part", "row", "rest"), "packing-fillers")
    gap, filler = (df.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0] for df, c in ((gaps, "gap"), (fillers, "rest")))
    laid, n_laid = _end_to_end(fillers, gap, filler, capacity, n_patterned)
    pieces = whole.unionByName(_fills(fillers, gaps, gap, filler)).unionByName(laid)
    # A group is one document's rest, cut at most into as many pieces as it has ids.
    places = pieces.groupBy("row").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))

    fulls = rows.groupBy("part").agg(F.sum(F.expr(f"n div {capacity}")).alias("c"))
    # One row per task.
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = fulls.select("part", F.coalesce(F.sum("c").over(by_part), F.lit(0)).alias("earlier"))
    based = attach(rows.select("row", "part", "doc_id", "n", "ids", "fulls"), first, ["part"])
    based = based.withColumn("first_full", F.col("earlier") + F.col("fulls") + F.lit(n_patterned + n_laid))
    return _cut(based.join(places.hint("shuffle_hash"), "row", "left"), capacity)
