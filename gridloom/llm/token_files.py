"""Token ids in bit-plane files.

Documents are laid out in ascending order of their id over the files of one folder, each file a
stream of ids. A stream is cut into blocks of a fixed number of ids. A block is transposed into
byte planes (or bit planes), each plane compressed with zstandard, and becomes one row:

====================  ======================================================================
``shard, chunk``      the chunk index: file number, block number within it
``at, n_ids``         first id of the block within its file, ids in the block
``kind, crc``         ``byte`` or ``bit`` planes; CRC-32 of the block before transposing
``planes``            compressed planes, lowest byte or bit first
``doc_no, doc_id``    per piece of a document in the block: its number in the file, its id
``doc_at, doc_ids``   the document's first id within the file, ids of the whole document
``piece_ids``         ids of the document that lie in this block
====================  ======================================================================

The rows are Spark-written Parquet (planes uncompressed by it), so any store Spark can write to
will do and a lost executor leaves no half-written file behind.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from gridloom.llm.common import importable
from gridloom.llm.kept import Kept

BLOCK = 65_536
# Chunks (and words) that a worker keeps; bytes of text encoded at a time.
KEPT, SLICE_BYTES = 250_000, 1 << 22
SCHEMA = (
    "shard int, chunk int, at long, n_ids int, kind string, crc long, planes array<binary>, doc_no array<long>, "
    "doc_id array<long>, doc_at array<long>, doc_ids array<long>, piece_ids array<int>"
)
PIECES = "shard int, doc_no long, doc_id long, doc_at long, doc_ids long, at long, ids binary"


def to_planes(ids: bytes, kind: str, level: int) -> list[bytes]:
    """Little-endian 32-bit ids as compressed planes."""
    rows = np.frombuffer(ids, dtype=np.uint8).reshape(-1, 4)
    if kind == "bit":
        planes = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")
    else:
        planes = np.ascontiguousarray(rows.T)
    squeeze = zstandard.ZstdCompressor(level=level).compress
    return [squeeze(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], n_ids: int, kind: str) -> bytes:
    """The ids of a block again."""
    size = (n_ids + 7) // 8 if kind == "bit" else n_ids
    spread = zstandard.ZstdDecompressor().decompress
    rows = [np.frombuffer(spread(p, max_output_size=max(size, 1)), dtype=np.uint8) for p in planes]
    if kind == "bit":
        bits = np.unpackbits(np.stack(rows), axis=1, bitorder="little")[:, :n_ids]
        return np.packbits(bits.T, axis=1, bitorder="little").tobytes()
    out = np.empty((n_ids, len(rows)), dtype=np.uint8)
    for k, row in enumerate(rows):
        out[:, k] = row
    return out.tobytes()


def _shape(specification: dict) -> tuple:
    """What of a tokenizer's file decides whether words can be encoded apart: all but its vocabulary."""
    model = {k: v for k, v in specification["model"].items() if k not in ("vocab", "merges")}
    parts = (specification.get("normalizer"), specification.get("pre_tokenizer"), model)
    return tuple(json.dumps(p, sort_keys=True) for p in parts)


# The pattern and the steps of the files whose words can be encoded apart.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "model": {
        "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>",
        "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}


class CachedEncoder:
    """Ids of texts, equal to the tokenizer's own.

    For tokenizers of the shape ``SPLIT_WORDS`` (white space is dropped, words end in a marked token),
    texts are cut at spaces and line feeds by Arrow, and each distinct chunk of a batch is looked up or
    encoded once. Chunks and words are kept, those used least recently make room for others. Any other
    tokenizer encodes whole texts.
    """

    def __init__(self, path: str, limit: int = KEPT):
        self.tokenizer = Tokenizer.from_file(path)
        # All ids are below.
        self.n_ids = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        with open(path, encoding="utf-8") as file:
            specification = json.load(file)
        self.added = [t["content"] for t in specification.get("added_tokens", [])]
        whole = specification.get("truncation") is None and specification.get("padding") is None
        self.by_words = whole and _shape(specification) == _shape(SPLIT_WORDS) and all(t.startswith("<|") for t in self.added)
        if not self.by_words:
            return
        # The same for words that are in lower case and cut already.
        self.of_words = Tokenizer.from_file(path)
        self.of_words.normalizer = normalizers.Sequence([])
        cut = [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        self.of_words.pre_tokenizer = pre_tokenizers.Sequence(cut)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.last[i] = token.endswith("</w>")
        self.words = regex.compile(WORD_PATTERN)
        # Special strings, and letters whose lower case depends on context, are left to the tokenizer.
        self.odd = regex.compile(r"<\||[\u0130\u03a3]")
        self.chunks, self.known_words = Kept(limit), Kept(limit)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunk_words(self, chunk: str) -> list[str]:
        """The words of a chunk in lower case; the pattern is only needed beyond letters and one mark."""
        if chunk.isalpha():
            return [chunk.lower()]
        if chunk[-1:] in {".", ",", ";", ":", "?", "!"} and chunk[:-1].isalpha():
            return [chunk[:-1].lower(), chunk[-1]]
        return self.words.findall(chunk.lower())

    def _learn_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, encoded as one text: each ends in exactly one token marked as last, which cuts it again."""
        ids = np.array(self.of_words.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        sizes = np.diff(np.flatnonzero(self.last[ids]), prepend=-1)
        if len(sizes) == len(words):
            return ids, sizes
        each = self._ids(words)
        return np.concatenate(each), np.array([len(i) for i in each])

    def _learn_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks by the words in them; what is not plain is left to the tokenizer."""
        odd, words, counts, odd_at = self.odd.search, [], [], []
        for i, c in enumerate(chunks):
            if c.isprintable() and ("<|" not in c if c.isascii() else not odd(c) and is_normalized("NFC", c)):
                if c.isalpha():
                    words.append(c.lower())
                    counts.append(1)
                else:
                    own = self._chunk_words(c)
                    words += own
                    counts.append(len(own))
            else:
                odd_at.append(i)
                counts.append(0)
        distinct = list(set(words))
        slot_of = dict(zip(distinct, self.known_words.slots(distinct, self._learn_words).tolist()))
        ids, of_word = self.known_words.runs.take(np.array([slot_of[w] for w in words], dtype=np.int64))
        upto = np.concatenate(([0], np.cumsum(of_word)))[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]
        if not odd_at:
            return ids, np.diff(upto)
        parts, sizes, a = [], np.diff(upto), 0
        for i, own in zip(odd_at, self._ids([chunks[i] for i in odd_at])):
            parts += [ids[a : upto[i]], own]
            a, sizes[i] = upto[i], len(own)
        return np.concatenate([*parts, ids[a:]]), sizes

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text begins (one more at the end)."""
        if not self.by_words:
            ids = self._ids(texts.to_pylist())
            return np.concatenate([np.zeros(0, dtype="<u4"), *ids]), np.concatenate(([0], np.cumsum([len(i) for i in ids]))).astype(np.int64)
        lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        chunks = lists.flatten().dictionary_encode()
        slots = self.chunks.slots(chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), self._learn_chunks)
        own, sizes = self.chunks.runs.take(slots)
        offsets = np.concatenate(([0], np.cumsum(sizes))) * 4
        distinct = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(own)])
        laid = distinct.take(chunks.indices)
        upto = np.frombuffer(laid.buffers()[1], dtype=np.int64, count=len(laid) + 1) // 4
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.frombuffer(laid.buffers()[2] or b"", dtype="<u4", count=int(upto[-1])), upto[np.concatenate(([0], np.cumsum(counts)))]


_ENCODERS: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """One encoder per worker process, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = CachedEncoder(path)
    return _ENCODERS[path]


def text_slices(texts: pa.Array, n_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """A column without NULLs in parts of about so many bytes (one text at least), each with its first row."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // n_bytes
    bounds = np.flatnonzero(np.diff(part, prepend=-1, append=len(texts) * n_bytes + 1) != 0) if len(texts) else []
    for a, b in zip(bounds, bounds[1:]):
        yield int(a), texts.slice(a, b - a)


def _schema_of(batch: list[dict]) -> pa.RecordBatch:
    types = pa.schema([
        ("shard", pa.int32()), ("chunk", pa.int32()), ("at", pa.int64()), ("n_ids", pa.int32()), ("kind", pa.string()),
        ("crc", pa.int64()), ("planes", pa.list_(pa.binary())), ("doc_no", pa.list_(pa.int64())), ("doc_id", pa.list_(pa.int64())),
        ("doc_at", pa.list_(pa.int64())), ("doc_ids", pa.list_(pa.int64())), ("piece_ids", pa.list_(pa.int32())),
    ])
    return pa.RecordBatch.from_pylist(batch, schema=types)


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, kind: str = "byte", block: int = BLOCK, level: int = 1,
    id: str = "doc_id", text: str = "text",
) -> None:
    """Encodes every text, appends ``end_id`` and writes the files, in ascending order of ``id``.

    NULL texts are empty (the end id alone); NULL ids come first; rows that share an id keep a fixed
    order. An empty table gives an empty folder. One shuffle by range, so files follow each other.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shard = encoder(vocabulary), TaskContext.get().partitionId()
        # Ids not yet written, where they begin in the file, and the documents they are of.
        ids, at, chunk, doc_no = np.zeros(0, dtype="<u4"), 0, 0, 0
        number, key, first, size = (np.zeros(0, dtype=np.int64) for _ in range(4))
        key = pa.array([], pa.int64())

        def emit(n: int, last: bool) -> Iterator[dict]:
            """Blocks of ``n`` ids, and what remains if it is the last; forgets what they hold."""
            nonlocal ids, at, chunk, number, key, first, size
            a = 0
            while len(ids) - a >= n or (last and a < len(ids)):
                raw = ids[a : a + n]
                lo, hi = at + a, at + a + len(raw)
                i, j = int(np.searchsorted(first + size, lo, side="right")), int(np.searchsorted(first, hi))
                inside = np.minimum(first[i:j] + size[i:j], hi) - np.maximum(first[i:j], lo)
                yield {
                    "shard": shard, "chunk": chunk, "at": lo, "n_ids": len(raw), "kind": kind, "crc": zlib.crc32(raw), "planes": to_planes(raw.tobytes(), kind, level),
                    "doc_no": number[i:j], "doc_id": key.slice(i, j - i).to_pylist(), "doc_at": first[i:j], "doc_ids": size[i:j], "piece_ids": inside,
                }
                chunk, a = chunk + 1, a + len(raw)
            ids, at = ids[a:], at + a
            i = int(np.searchsorted(first + size, at, side="right"))
            number, key, first, size = number[i:], key.slice(i), first[i:], size[i:]

        for batch in batches:
            for row, part in text_slices(batch.column(1)):
                more, begins = own.flat(part)
                more = np.insert(more, begins[1:], end_id).astype("<u4", copy=False)
                sizes, base = np.diff(begins) + 1, at + len(ids)
                ids = np.concatenate((ids, more))
                number = np.concatenate((number, doc_no + np.arange(len(sizes))))
                key = pa.concat_arrays([key, batch.column(0).slice(row, len(sizes))])
                first, size = np.concatenate((first, base + np.cumsum(sizes) - sizes)), np.concatenate((size, sizes))
                doc_no += len(sizes)
                out = list(emit(block, False))
                if out:
                    yield _schema_of(out)
        out = list(emit(block, True))
        if out:
            yield _schema_of(out)

    importable(docs.sparkSession)
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    laid.mapInArrow(blocks, SCHEMA).write.option("compression", "none").parquet(path)


def token_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunk rows of a folder."""
    return spark.read.schema(SCHEMA).parquet(path)


def read_pieces(chunks: DataFrame, whole: bool | None = None) -> DataFrame:
    """The pieces of documents in each block: ``PIECES``. A damaged block is an error.

    ``whole`` asks for only those pieces that are (or are not) whole documents; the check is
    left out for the latter, as both are read together.
    """
    importable(chunks.sparkSession)
    names = [field.split(" ")[0] for field in PIECES.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def batch_of(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, size = [[] for _ in names], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                raw = from_planes(row["planes"], row["n_ids"], row["kind"])
                if whole is not False and zlib.crc32(raw) != row["crc"]:
                    raise ValueError(f"block {row['chunk']} of file {row['shard']} is damaged")
                a = 0
                for no, key, at, n, own in zip(row["doc_no"], row["doc_id"], row["doc_at"], row["doc_ids"], row["piece_ids"]):
                    if whole is None or whole == (n == own):
                        for column, v in zip(columns, (row["shard"], no, key, at, n, row["at"] + a, raw[a * 4 : (a + own) * 4])):
                            column.append(v)
                        size += own
                    a += own
                if size >= 16 * BLOCK:
                    yield batch_of(columns)
                    columns, size = [[] for _ in names], 0
        yield batch_of(columns)

    return chunks.mapInArrow(pieces, PIECES)


def shard_offsets(chunks: DataFrame) -> DataFrame:
    """``(shard, base)``: ids in all files before this one."""
    totals = chunks.groupBy("shard").agg(F.sum(F.col("n_ids").cast("long")).alias("n"))
    # One row per file: the window and the later broadcast are bounded by the number of write tasks.
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents read back: ``doc_id, start, n_tokens, ids`` with ids as little-endian 32-bit bytes.

    ``start`` counts the ids of all documents before. Only documents that cross a block are shuffled.
    """
    chunks = token_chunks(spark, path)
    inside = read_pieces(chunks, whole=True).select("shard", "doc_id", "doc_at", "doc_ids", "ids")
    joined = F.aggregate(F.sort_array(F.collect_list(F.struct("at", "ids"))), F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    # A group is one document, which is one row of the input too.
    crossing = read_pieces(chunks, whole=False).groupBy("shard", "doc_no", "doc_id", "doc_at", "doc_ids").agg(joined.alias("ids"))
    docs = inside.unionByName(crossing.drop("doc_no"))
    based = docs.join(F.broadcast(shard_offsets(chunks)), "shard")
    return based.select("doc_id", (F.col("base") + F.col("doc_at")).alias("start"), F.col("doc_ids").alias("n_tokens"), "ids")
