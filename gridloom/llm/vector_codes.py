"""Product quantization with memoised grid cells.

A vector is cut into parts, each with a codebook of its own. For the nearest entry of a part, its
coarse grid cell is looked up: the first time a cell is met, the least and the greatest distance of
every entry to the cell's box are compared, and the entries that some other entry beats everywhere in
the box (their least distance exceeds its greatest) are left out for good. Only the entries kept with
the cell are measured exactly, so the nearest one is that of a full scan, ties included.

Cells are kept per worker and codebook in a bounded memory. Codebooks are learnt by passes over the
stored vectors that return one sum per entry and component; they are the only thing on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import attach, importable, stored
from gridloom.llm.kept import Kept
from gridloom.llm.vectors import kept_vectors, matrix, pair_squares

# Cells kept for a codebook; rows measured at a time.
CELLS, ROWS = 50_000, 1024


class CellMemo:
    """The nearest entry of one part's codebook, through its grid cells of edge ``edge``."""

    def __init__(self, entries: np.ndarray, edge: int, limit: int = CELLS):
        self.entries, self.edge = entries, edge
        self.cells = Kept(limit, "<u2")
        self.n_measured = 0

    def _candidates(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Entries that are nowhere in the cells' boxes beaten by one other entry, ascending, and their numbers."""
        low = np.frombuffer(b"".join(names), dtype=np.int64).reshape(len(names), -1) * self.edge
        found, sizes = [], []
        for a in range(0, len(names), ROWS):
            lo = low[a : a + ROWS]
            least, greatest = (np.zeros((len(lo), len(self.entries)), dtype=np.int64) for _ in range(2))
            # Squares add up over the dimensions, and in one of them boxes have few places.
            for d, own in enumerate(self.entries.T):
                places, of_cell = np.unique(lo[:, d], return_inverse=True)
                below, above = places[:, None] - own, own - (places[:, None] + self.edge - 1)
                least += (np.maximum(np.maximum(below, above), 0) ** 2)[of_cell]
                greatest += (np.maximum(np.abs(below), np.abs(above)) ** 2)[of_cell]
            cell, entry = np.nonzero(least <= greatest.min(axis=1)[:, None])
            found.append(entry.astype("<u2"))
            sizes.append(np.bincount(cell, minlength=len(lo)))
        return np.concatenate(found), np.concatenate(sizes)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row and its squared distance; equal distances go to the lower entry."""
        code, square = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        for a in range(0, len(x), ROWS):
            part = x[a : a + ROWS]
            cells = np.ascontiguousarray(part // self.edge)
            names, of_row = np.unique(cells.view(f"V{cells.shape[1] * 8}").reshape(-1), return_inverse=True)
            slots = self.cells.slots([n.tobytes() for n in names], self._candidates)
            entry, sizes = self.cells.runs.take(slots[of_row])
            entry, starts = entry.astype(np.int64), np.cumsum(sizes) - sizes
            squares = pair_squares(part, np.repeat(np.arange(len(part)), sizes), self.entries, entry)
            least = np.minimum.reduceat(squares, starts)
            entry[squares != np.repeat(least, sizes)] = len(self.entries)
            code[a : a + ROWS], square[a : a + ROWS] = np.minimum.reduceat(entry, starts), least
            self.n_measured += len(squares)
        return code, square


_MEMOS: dict[tuple, list[CellMemo]] = {}


def memos(name: str, codebooks: np.ndarray, edge: int) -> list[CellMemo]:
    """The memories of these codebooks, kept from task to task; those of earlier codebooks are dropped."""
    if (name, edge) not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[name, edge] = [CellMemo(c, edge) for c in codebooks]
    return _MEMOS[name, edge]


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def _coded(batches: Iterator[pa.RecordBatch], codebooks: np.ndarray, name: str, edge: int):
    """Per batch: the batch, its vectors by part, and each part's entry and squared distance."""
    n_parts, _, width = codebooks.shape
    for batch in batches:
        x = matrix(batch.column("x"), n_parts * width).reshape(-1, n_parts, width)
        found = [memo.nearest(x[:, p]) for p, memo in enumerate(memos(name, codebooks, edge))]
        yield batch, x, np.stack([c for c, _ in found], axis=1), np.stack([d for _, d in found], axis=1)


def entry_sums(vectors: DataFrame, codebooks: np.ndarray, edge: int) -> DataFrame:
    """``part, entry, at, n, s``: how many parts chose an entry, and the sum of each component; tasks add up their own first."""
    shared, name = vectors.sparkSession.sparkContext.broadcast(codebooks), digest(codebooks)
    n_parts, size, width = codebooks.shape

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros((n_parts, size), dtype=np.int64), np.zeros((n_parts, size, width), dtype=np.int64)
        for _, x, codes, _ in _coded(batches, shared.value, name, edge):
            for p in range(n_parts):
                n[p] += np.bincount(codes[:, p], minlength=size)
                np.add.at(s[p], codes[:, p], x[:, p])
        part, entry = np.nonzero(n)
        columns = [np.repeat(part, width), np.repeat(entry, width), np.tile(np.arange(width), len(part)), np.repeat(n[part, entry], width), s[part, entry].reshape(-1)]
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["part", "entry", "at", "n", "s"])

    sums = vectors.select("x").mapInArrow(share, "part long, entry long, at long, n long, s long")
    return sums.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def learnt(vectors: DataFrame, codebooks: np.ndarray, rounds: int, edge: int) -> np.ndarray:
    """The codebooks after so many rounds; an entry no part chose stays."""
    for _ in range(rounds):
        codebooks = codebooks.copy()
        # One number per entry and component.
        for p, e, at, n, s in entry_sums(vectors, codebooks, edge).collect():
            codebooks[p, e, at] = s // n
    return codebooks


def encoded(vectors: DataFrame, codebooks: np.ndarray, edge: int) -> DataFrame:
    """``vec_id, label, code, error`` of each vector."""
    shared, name = vectors.sparkSession.sparkContext.broadcast(codebooks), digest(codebooks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, codes, squares in _coded(batches, shared.value, name, edge):
            text = [bytes(row).hex() for row in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(squares.sum(axis=1))], names=["vec_id", "label", "code", "error"]
            )

    label = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "x", "label").mapInArrow(encode, f"vec_id long, label {label}, code string, error long")


def vector_codes(
    df: DataFrame, parts: int = 4, size: int = 256, rounds: int = 4, scale: int = 1024, edge: int = 32,
    id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> DataFrame:
    """Per kept vector: ``vec_id, code, error, label_error, codebooks_sha256``.

    Vectors that are NULL or hold NULL or a number that is not finite are left out. Parts need one
    length: that of most vectors (the greater on a tie) among those that ``parts`` divides; vectors of
    other lengths have no code and are left out too. Codebooks start with the ``size`` (256 at most) rows
    of the smallest ids; rows without an id come last, rows that share an id by their vectors. Fewer rows
    are fewer entries. ``label_error`` adds up errors over equal labels, NULL being one. ``edge`` is the
    edge of a grid cell and does not change the result. Rows that share an id keep a code each. An empty
    table gives an empty result. A component beyond 2^27 after scaling is an error.
    """
    if not 1 <= size <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    spark = df.sparkSession
    importable(spark)
    rows = kept_vectors(df.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("embedding"), F.col(label).alias("label")), "embedding", scale)
    rows = stored(rows.select("vec_id", "x", "label", F.size("x").alias("width")), "code-vectors")
    lengths = rows.where((F.col("width") > 0) & (F.col("width") % parts == 0)).groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    if lengths is None:
        kind = df.schema[label].dataType.simpleString()
        empty = spark.createDataFrame([], f"vec_id long, label {kind}, code string, error long, label_error long, codebooks_sha256 string")
        return empty.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    kept = rows.where(F.col("width") == lengths["width"])
    start = np.array([r["x"] for r in kept.orderBy(F.asc_nulls_last("vec_id"), "x").limit(size).select("x").collect()], dtype=np.int64)
    codebooks = np.ascontiguousarray(start.reshape(len(start), parts, -1).transpose(1, 0, 2))
    codebooks = learnt(kept, codebooks, rounds, edge)
    coded = stored(encoded(kept, codebooks, edge), "vector-codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    return attach(coded, totals, ["label"]).select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
