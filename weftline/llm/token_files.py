"""Token ids in patched frame-of-reference files (operator 6).

File (little-endian): magic; packed words; exceptions; the index (each document's key and first id; each block's minimum, width, first
word and first exception); last the counts of documents, of those without a key (they come first), ids, blocks and exceptions. A block is
BLOCK ids less their minimum, packed at the width that holds PERCENTILE of them; what is wider keeps its low bits there and goes, whole,
to the exception list. Any document is read by its index entry and the blocks it touches.

Documents are dealt by ranges of their key, so a hot source or long texts spread. A task writes its range's packed words as they come and
holds STEP blocks of ids, the exceptions and the index, not the range's texts or ids. Files are written under a temporary name and renamed,
with the same bytes for every attempt, so lost executors and repeated tasks leave whole files. Only one row for each file (its key range
and count of ids) comes to the driver.

Defined cases: a null or empty text is its end id alone. Rows with equal keys are kept, in an order that their texts fix, each with
its own start; rows with a null key come first. Keys are whole numbers (others are refused). No rows make no file. Extra columns are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import materialize, release, whole_number_ids
from weftline.llm.pieces import BytePattern, IdCache, hash_spans, quiet_tokenizers, tokenizer_path
from weftline.llm.spans import slices
from weftline.session import ship
from weftline.sources.shared import qualified, scratch

MAGIC = b"WLPF0003"
BLOCK, PERCENTILE, STEP = 256, 0.95, 4096
#: Bytes of text that a range should hold at most, by the mean text.
RANGE_BYTES = 32 << 20


# --- the format ---------------------------------------------------------------------------------------------------

def pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK unsigned values at `width` bits each: rows of BLOCK * width / 64 words."""
    lanes = values.reshape(-1, 64).T.astype(np.uint64)
    out = np.zeros((width, lanes.shape[1]), np.uint64)
    for i in range(64):
        word, bit = divmod(i * width, 64)
        out[word] |= lanes[i] << np.uint64(bit)
        if bit + width > 64:
            out[word + 1] |= lanes[i] >> np.uint64(64 - bit)
    return np.ascontiguousarray(out.T).reshape(len(values), -1)


def unpack(words: np.ndarray, width: int) -> np.ndarray:
    """The inverse of pack()."""
    lanes = words.reshape(-1, width).T
    out, mask = np.empty((64, lanes.shape[1]), np.uint64), np.uint64((1 << width) - 1)
    for i in range(64):
        word, bit = divmod(i * width, 64)
        x = lanes[word] >> np.uint64(bit)
        if bit + width > 64:
            x = x | (lanes[word + 1] << np.uint64(64 - bit))
        out[i] = x & mask
    return np.ascontiguousarray(out.T).reshape(len(words), -1).astype(np.uint32)


def _encode_blocks(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """(minimum, width, packed words, exceptions of each block, their positions, their values) of some whole blocks."""
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    at = min(BLOCK - 1, int(np.ceil(PERCENTILE * BLOCK)) - 1)
    typical = np.partition(rest, at, axis=1)[:, at]
    width = np.where(typical > 0, np.floor(np.log2(np.maximum(typical, 1).astype(np.float64))) + 1, 0).astype(np.uint8)
    odd = rest.astype(np.uint64) >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    first_word = np.concatenate(([0], np.cumsum(width.astype(np.int64) * (BLOCK // 64))))
    body = np.zeros(first_word[-1], np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        own = np.flatnonzero(width == w)
        packed = pack(rest[own] & np.uint32((1 << w) - 1), w)
        body[first_word[own][:, None] + np.arange(packed.shape[1])] = packed
    return least, width, body, odd.sum(axis=1), (np.flatnonzero(odd.ravel()) % BLOCK).astype(np.uint16), rest[odd]


class TokenWriter:
    """Writes a file to a stream, document by document; close() puts the index at its end."""

    def __init__(self, out, step: int = STEP):
        self.out, self.step, self.size = out, step, 0
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n = self.keyless = 0
        self.docs: list[tuple[np.ndarray, np.ndarray]] = []
        self.blocks: list[tuple[np.ndarray, ...]] = []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray, keyless: int = 0) -> None:
        """keys: int64 of each document, of which `keyless` (the file's first) have none; lengths: ids of each; ids: uint32 of all."""
        self.docs.append((keys.astype("<i8"), lengths.astype("<i8")))
        self.keyless += keyless
        self.n += len(ids)
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.step * BLOCK:
            self._encode(False)

    def _encode(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.uint32)
        whole = len(ids) if last else len(ids) // BLOCK * BLOCK
        rest = ids[whole:]
        for lo in range(0, whole, self.step * BLOCK):
            some = ids[lo : min(lo + self.step * BLOCK, whole)]
            if len(some) % BLOCK:
                some = np.concatenate((some, np.full(-len(some) % BLOCK, some[-1], np.uint32)))
            least, width, body, n_odd, odd_at, odd = _encode_blocks(some.reshape(-1, BLOCK))
            self._put(body.astype("<u8").tobytes())
            self.blocks.append((least, width, n_odd, odd_at, odd))
        self.waiting, self.n_waiting = [rest] if len(rest) else [], len(rest)

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, bytes) of the file."""
        self._encode(True)
        none = (np.empty(0, np.uint32), np.empty(0, np.uint8), *[np.empty(0, np.int64)] * 3)
        least, width, n_odd, odd_at, odd = (np.concatenate(x) for x in zip(*self.blocks, strict=True)) if self.blocks else none
        keys, lengths = (np.concatenate(x) for x in zip(*self.docs, strict=True)) if self.docs else (np.empty(0, "<i8"), np.empty(0, "<i8"))
        first_word, first_odd, starts = (np.concatenate(([0], np.cumsum(x, dtype=np.int64))) for x in (width.astype(np.int64) * (BLOCK // 64), n_odd, lengths))
        for part in (odd_at.astype("<u2"), odd.astype("<u4"), keys, starts.astype("<u8"), least.astype("<u4"), width, first_word.astype("<u8"), first_odd.astype("<u8")):
            self._put(part.tobytes())
        self._put(struct.pack("<QQQQQ", len(keys), self.keyless, self.n, len(width), len(odd_at)))
        return len(keys), self.n, self.size


def encode_file(keys: np.ndarray, starts: np.ndarray, ids: np.ndarray, step: int = STEP, keyless: int = 0) -> bytes:
    """A file's bytes. keys: int64 of each document, of which the first `keyless` have none; starts: its first id; ids: uint32 of all documents."""
    out = io.BytesIO()
    w = TokenWriter(out, step)
    w.add(keys, np.diff(np.append(starts, len(ids))), ids, keyless)
    w.close()
    return out.getvalue()


class TokenFile:
    """A file's bytes, opened: keys, starts, and ids of any range."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        docs, self.keyless, self.n, blocks, odd = struct.unpack("<QQQQQ", data[-40:])
        index = odd * 6 + docs * 8 + (docs + 1) * 8 + blocks * 5 + (blocks + 1) * 16
        pos = len(data) - 40 - index
        words, pos_body = (pos - 8) // 8, 8

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal pos
            out = np.frombuffer(data, kind, count, pos)
            pos += out.nbytes
            return out

        self.body = np.frombuffer(data, "<u8", words, pos_body)
        self.odd_at, self.odd = take("<u2", odd), take("<u4", odd)
        self.keys, self.starts = take("<i8", docs), take("<u8", docs + 1).astype(np.int64)
        self.least, self.width = take("<u4", blocks), take("u1", blocks)
        self.first_word, self.first_odd = take("<u8", blocks + 1).astype(np.int64), take("<u8", blocks + 1).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """uint32 ids start to end, from the blocks that hold them."""
        if end <= start:
            return np.empty(0, np.uint32)
        a, b = start // BLOCK, -(-end // BLOCK)
        out = np.zeros((b - a, BLOCK), np.uint32)
        width = self.width[a:b]
        for w in np.unique(width[width > 0]).tolist():
            own = np.flatnonzero(width == w)
            out[own] = unpack(self.body[self.first_word[a + own][:, None] + np.arange(w * BLOCK // 64)], w)
        lo, hi = self.first_odd[a], self.first_odd[b]
        row = np.repeat(np.arange(b - a), np.diff(self.first_odd[a : b + 1]))
        out[row, self.odd_at[lo:hi]] = self.odd[lo:hi]
        out += self.least[a:b, None]
        return out.ravel()[start - a * BLOCK : end - a * BLOCK]


# --- encoding -----------------------------------------------------------------------------------------------------

_encoders: dict[str, "BpeEncoder"] = {}


class BpeEncoder:
    """A tokenizers file; pre-tokens are encoded once for each worker."""

    def __init__(self, path: str):
        quiet_tokenizers()
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()]
        self.pattern = BytePattern(self.lib)
        self.cache = IdCache(self._encode)

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.lib.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        return np.fromiter((i for x in got for i in x), np.int32), np.fromiter(map(len, got), np.int64, len(got))

    def encode_slice(self, raw: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(uint32 ids of all documents, each with the end id; offsets)."""
        whole, n = raw.tobytes(), len(offs) - 1
        if any(s in whole for s in self.special):  # a special token's string in a text is its id, which no pre-token shows
            got = [e.ids + [end_id] for e in self.lib.encode_batch_fast([whole[a:b].decode() for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], add_special_tokens=False)]
            return np.fromiter((i for x in got for i in x), np.uint32), np.concatenate(([0], np.cumsum([len(x) for x in got])))
        start, end = self.pattern.spans(raw, offs)
        where, count = self.cache.look_up(hash_spans(raw, offs, start, end), raw, start, end)
        ids = self.cache.ids(where, count)
        total = np.concatenate(([0], np.cumsum(count, dtype=np.int64)))[np.searchsorted(start, offs)]
        at = total + np.arange(n + 1)
        out = np.full(at[-1], end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(total))] = ids
        return out, at


def bpe_encoder(path: str) -> BpeEncoder:
    if path not in _encoders:
        _encoders[path] = BpeEncoder(path)
    return _encoders[path]


# --- writing and reading ------------------------------------------------------------------------------------------

def _store(uri: str):
    """A file system for pyarrow and the place in it; the uri has its scheme, as qualified() gives it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


_MANIFEST = "shard int, file string, n_docs long, n_tokens long, n_file_bytes long"


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", path: str | None = None, end_id: int = 0) -> DataFrame:
    """Encode every text, append end_id, and write the ids in ascending order of the key. Returns the files' rows: shard, file, n_docs, n_tokens, n_file_bytes."""
    spark = docs.sparkSession
    whole_number_ids(docs, id_col)
    ship(spark)
    folder = qualified(spark, folder)

    def run(batches):
        coder, writer, part = bpe_encoder(path or tokenizer_path(tokenizer)), None, None
        shard = TaskContext.get().partitionId()
        store, place = _store(folder)
        name = f"{place}/tokens-{shard:06d}.pfor"
        for b in batches:
            if b.num_rows and writer is None:
                store.create_dir(place, recursive=True)
                out = store.open_output_stream(part := f"{name}.{uuid.uuid4().hex}")
                writer = TokenWriter(out)
            for lo, hi, raw, offs in slices(b.column(1)):
                got, at = coder.encode_slice(raw, offs, end_id)
                key = b.column(0).slice(lo, hi - lo)
                writer.add(key.fill_null(0).to_numpy(), np.diff(at), got, key.null_count)  # nulls come first
        if writer is None:
            return
        n_docs, n_ids, size = writer.close()
        out.close()
        store.move(part, name)
        cols = [[shard], [f"tokens-{shard:06d}.pfor"], [n_docs], [n_ids], [size]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["shard", "file", "n_docs", "n_tokens", "n_file_bytes"])

    own = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    ranged = own.repartitionByRange(_ranges(docs, text_col), "key", F.xxhash64("text")).sortWithinPartitions("key", "text")
    return ranged.mapInArrow(run, _MANIFEST)


def _ranges(docs: DataFrame, text_col: str) -> int:
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0
    return max(1, spark.sparkContext.defaultParallelism, -(-total // RANGE_BYTES))


def read_token_files(spark: SparkSession, folder: str, manifest: list) -> DataFrame:
    """One row per document from the files: key, start (ids of all documents before it), n_tokens, ids_crc32. manifest: collected rows of write_token_files()."""
    ship(spark)
    folder = qualified(spark, folder)
    rows, base = [], 0
    for r in sorted(manifest, key=lambda r: r["shard"]):
        rows.append((r["file"], base))
        base += r["n_tokens"]
    schema = T.StructType([T.StructField("file", T.StringType()), T.StructField("base", T.LongType())])

    def run(batches):
        store, place = _store(folder)
        for b in batches:
            for name, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_stream(f"{place}/{name}") as f:
                    file = TokenFile(f.read())
                yield from _documents(file, first)

    frame = spark.createDataFrame(rows, schema)
    return frame.repartition(max(1, len(rows)), "file").mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")


def _documents(file: TokenFile, base: int, step: int = 4096):
    n = len(file.keys)
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        at = file.starts[lo : hi + 1]
        data = memoryview(file.ids(int(at[0]), int(at[-1])).astype("<u4")).cast("B")
        cut = ((at - at[0]) * 4).tolist()
        crc = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)), np.int64, hi - lo)
        keys = file.keys[lo:hi]
        yield pa.RecordBatch.from_arrays([pa.array(keys, mask=np.arange(lo, hi) < file.keyless), pa.array(base + at[:-1]), pa.array(np.diff(at)), pa.array(crc)], names=["key", "start", "n_tokens", "ids_crc32"])


def token_file_digest(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write the files (below spark.checkpoint.dir unless named), read them back, and return what they hold of each document."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    kept = materialize(write_token_files(docs, folder, **options), "token-files")
    written = kept.collect()  # a row for each file
    release(kept)
    return read_token_files(spark, folder, written).withColumnRenamed("key", options.get("id_col", "doc_id"))
