"""Token ids in binary shard files: patched frame-of-reference blocks.

A shard holds the documents of one range of doc_id, ascending, as one stream of ids, each document ended by END_ID.
Layout, all little-endian:
  magic b"PFOR0001"
  blocks of BLOCK ids (the last may be short), each:
    u32 minimum, u8 width, u8 0, u16 number of exceptions,
    the ids less the minimum, packed at `width` bits, low bits first, in whole bytes,
    per exception u16 place and u32 value (less the minimum); packed bits there are zero
  index: u64 start of each block, i64 doc_id of each document, u8 whether that id is null, u64 start of each document
    in the stream of the shard
  footer: u64 offset of the index, u64 blocks, u64 documents, u64 ids, magic
The width is the least that holds PERCENTILE percent of a block's ids; the others are exceptions.

Encoding happens where documents are read; only ids (two bytes each where the vocabulary allows it) are dealt to doc_id
ranges, whose bounds come from the doc_id column alone; a doc_id of very many rows gets several shards. Each task streams
its sorted rows into one file in the shared folder, under a name that only this attempt has. The manifest (one row per
file, of the attempts that Spark counts) says which files there are and gives each shard's place in the stream of all
documents, so a task that runs again, or twice at a time, replaces nothing; what other attempts left is deleted.

Defined results: null and empty texts hold only the end id; rows with equal doc_id stay apart and are ordered by their
ids (within a shard, where they fill several), null doc_id comes first; an empty table writes no file and gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm import bpe
from orrery.llm.bpe import bytes_of, spread
from orrery.llm.common import Staging, bounded_batches

MAGIC = b"PFOR0001"
BLOCK = 1024
PERCENTILE = 90
END_ID = 2
#: Blocks that are coded together.
MANY = 256
MOST_SHARDS = 10_000


# Blocks.


def pack(values: np.ndarray) -> list[bytes]:
    """The blocks of a stream of ids; all but the last have BLOCK ids."""
    out: list[bytes] = []
    n = len(values) // BLOCK * BLOCK
    if n:
        out += _pack(values[:n].reshape(-1, BLOCK).astype(np.int64))
    if n < len(values):
        out += _pack(values[n:].reshape(1, -1).astype(np.int64))
    return out


def _pack(rows: np.ndarray) -> list[bytes]:
    least = rows.min(axis=1)
    rest = rows - least[:, None]
    k = min(rows.shape[1] - 1, rows.shape[1] * PERCENTILE // 100)
    widths = np.ceil(np.log2(np.partition(rest, k, axis=1)[:, k] + 1.0)).astype(np.int64)
    over = rest >= (1 << widths)[:, None]
    rest[over], odd = 0, rest[over]
    bodies: list[bytes] = [b""] * len(rows)
    for w in np.unique(widths).tolist():
        mine = np.flatnonzero(widths == w)
        for i, body in zip(mine.tolist(), lay(rest[mine], w)):
            bodies[i] = body.tobytes()
    n_odd = over.sum(axis=1)
    ends = np.cumsum(n_odd).tolist()
    places = np.nonzero(over)[1].astype("<u2")
    out = []
    for low, w, n, end, body in zip(least.tolist(), widths.tolist(), n_odd.tolist(), ends, bodies):
        out.append(struct.pack("<IBBH", low, w, 0, n) + body + places[end - n : end].tobytes() + odd[end - n : end].astype("<u4").tobytes())
    return out


def lay(values: np.ndarray, w: int) -> np.ndarray:
    """Rows of values below 2**w as rows of bytes, low bits first. Eight values are w bytes: two words hold four each."""
    m, n = values.shape
    size, groups = (n * w + 7) // 8, -(-n // 8)
    if w == 0:
        return np.empty((m, 0), np.uint8)
    if w > 16:
        bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(m, n, 4), axis=2, bitorder="little")[:, :, :w]
        return np.packbits(bits.reshape(m, n * w), axis=1, bitorder="little")
    v = np.zeros((m, groups * 8), "<u8")
    v[:, :n] = values
    v = v.reshape(m, groups, 8)
    half = v[:, :, 0::4].copy()
    for k in range(1, 4):
        half |= v[:, :, k::4] << np.uint64(k * w)
    words = np.zeros((m, groups, 2), "<u8")
    words[:, :, 0], words[:, :, 1] = half[:, :, 0], half[:, :, 1]
    if w < 16:
        words[:, :, 0] |= half[:, :, 1] << np.uint64(4 * w)
        words[:, :, 1] = half[:, :, 1] >> np.uint64(64 - 4 * w)
    return words.view(np.uint8).reshape(m, groups, 16)[:, :, :w].reshape(m, groups * w)[:, :size]


def lift(bodies: np.ndarray, n: int, w: int) -> np.ndarray:
    """The n values in each row of bytes that `lay` made."""
    m, groups = len(bodies), -(-n // 8)
    if w == 0:
        return np.zeros((m, n), np.int64)
    if w > 16:
        bits = np.zeros((m, n, 32), np.uint8)
        bits[:, :, :w] = np.unpackbits(bodies, axis=1, count=n * w, bitorder="little").reshape(m, n, w)
        return np.packbits(bits, axis=2, bitorder="little").view("<u4")[:, :, 0].astype(np.int64)
    raw = np.zeros((m, groups * w), np.uint8)
    raw[:, : bodies.shape[1]] = bodies
    words = np.zeros((m, groups, 16), np.uint8)
    words[:, :, :w] = raw.reshape(m, groups, w)
    words = words.view("<u8")
    full, mask = np.uint64((1 << 4 * w) - 1), np.uint64((1 << w) - 1)
    low, high = words[:, :, 0] & full, words[:, :, 1]
    if w < 16:
        high = (words[:, :, 0] >> np.uint64(4 * w) | words[:, :, 1] << np.uint64(64 - 4 * w)) & full
    out = np.empty((m, groups, 8), np.int64)
    for k in range(4):
        out[:, :, k], out[:, :, k + 4] = low >> np.uint64(k * w) & mask, high >> np.uint64(k * w) & mask
    return out.reshape(m, groups * 8)[:, :n]


def unpack(blocks: list[bytes | memoryview], sizes: list[int]) -> list[np.ndarray]:
    """The ids of blocks that hold so many each; blocks of one size and width are taken together."""
    heads = [struct.unpack_from("<IBBH", b) for b in blocks]
    alike: dict[tuple[int, int], list[int]] = {}
    for i, (n, (_, w, _, _)) in enumerate(zip(sizes, heads)):
        alike.setdefault((n, w), []).append(i)
    out: list = [None] * len(blocks)
    for (n, w), mine in alike.items():
        size = (n * w + 7) // 8
        values = lift(np.frombuffer(b"".join([blocks[i][8 : 8 + size] for i in mine]), np.uint8).reshape(len(mine), size), n, w)
        for i, v in zip(mine, values):
            least, _, _, odd = heads[i]
            if odd:
                v[np.frombuffer(blocks[i], "<u2", odd, 8 + size)] = np.frombuffer(blocks[i], "<u4", odd, 8 + size + 2 * odd)
            v += least
            out[i] = v
    return out


# Files.


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else os.path.abspath(uri))


class Writer:
    """Streams documents into one shard file."""

    def __init__(self, uri: str):
        self.fs, path = _at(uri)
        self.fs.create_dir(os.path.dirname(path), recursive=True)
        self.out = self.fs.open_output_stream(path)
        self.out.write(MAGIC)
        self.at, self.n_ids = len(MAGIC), 0
        self.blocks: list[int] = []
        self.docs: list[np.ndarray] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, ids: list[np.ndarray]) -> None:
        lens = np.fromiter(map(len, ids), np.int64, len(ids))
        starts = self.n_ids + np.cumsum(lens) - lens
        self.docs.append(np.stack([doc_ids.astype(np.int64), nulls.astype(np.int64), starts], axis=1))
        self.n_ids += int(lens.sum())
        self.waiting += ids
        self.n_waiting += int(lens.sum())
        if self.n_waiting >= BLOCK * MANY:
            self._flush(False)

    def _flush(self, all_of_it: bool) -> None:
        stream = np.concatenate(self.waiting) if self.waiting else np.empty(0, np.int64)
        n = len(stream) if all_of_it else len(stream) // BLOCK * BLOCK
        for k in range(0, n, BLOCK * MANY):
            for b in pack(stream[k : min(n, k + BLOCK * MANY)]):
                self.blocks.append(self.at)
                self.out.write(b)
                self.at += len(b)
        self.waiting, self.n_waiting = [stream[n:]], len(stream) - n

    def close(self) -> tuple[int, int]:
        """Documents and ids of the file."""
        self._flush(True)
        docs = np.concatenate(self.docs)
        index = np.array(self.blocks, "<u8").tobytes() + docs[:, 0].astype("<i8").tobytes() + docs[:, 1].astype("u1").tobytes() + docs[:, 2].astype("<u8").tobytes()
        self.out.write(index + struct.pack("<QQQQ", self.at, len(self.blocks), len(docs), self.n_ids) + MAGIC)
        self.out.close()
        return len(docs), self.n_ids


class Reader:
    """Random and sequential access to a shard file by its block index."""

    def __init__(self, uri: str):
        filesystem, path = _at(uri)
        self.file = filesystem.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(32 + len(MAGIC), size - 32 - len(MAGIC))
        if tail[32:] != MAGIC:
            raise ValueError(f"{uri} is no shard file")
        self.index_at, blocks, docs, self.n_ids = struct.unpack("<QQQQ", tail[:32])
        index = self.file.read_at(size - 32 - len(MAGIC) - self.index_at, self.index_at)
        self.blocks = np.append(np.frombuffer(index, "<u8", blocks).astype(np.int64), self.index_at)
        self.doc_ids = np.frombuffer(index, "<i8", docs, 8 * blocks)
        self.nulls = np.frombuffer(index, "u1", docs, 8 * blocks + 8 * docs).astype(bool)
        self.starts = np.append(np.frombuffer(index, "<u8", docs, 8 * blocks + 9 * docs).astype(np.int64), self.n_ids)

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids in [start, stop) of the shard's stream; only the blocks that hold them are read."""
        first, last = start // BLOCK, (max(stop, start + 1) - 1) // BLOCK
        base = int(self.blocks[first])
        data = memoryview(self.file.read_at(int(self.blocks[last + 1]) - base, base))
        borders = (self.blocks[first : last + 2] - base).tolist()
        parts = unpack([data[a:b] for a, b in zip(borders, borders[1:])], [min(BLOCK, self.n_ids - k * BLOCK) for k in range(first, last + 1)])
        return np.concatenate(parts)[start - first * BLOCK : stop - first * BLOCK]

    def documents(self, at_once: int = BLOCK * 4096) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(first, last + 1, ids of each document), a bounded number of ids at a time (or one document)."""
        k, n = 0, len(self.doc_ids)
        while k < n:
            j = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + at_once, side="right")) - 1)
            ids = self.read(int(self.starts[k]), int(self.starts[j]))
            yield k, j, np.split(ids, self.starts[k + 1 : j] - self.starts[k])
            k = j


# Encoding with the tokenizers library.

#: Pieces that may be joined in one text: a space, then no other at either end.
JOINED = "(?s)^ [\\pL\\pN!-~](.*[\\pL\\pN!-~])?$"
#: Pieces in one text.
JOIN = 500


class LibraryEncoder(bpe.Encoder):
    """Pieces go to the tokenizers library, each distinct one once, many in one text."""

    def __init__(self, path: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        super().__init__(path)
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(self.path)
        self.library.no_truncation()
        self.library.no_padding()
        self.n_bytes = np.array([len(b) for b in self.bytes], np.int64)

    def _encoded(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that begin with a space are joined: no token spans the border, so byte counts part the ids again."""
        plain = pc.match_substring_regex(pieces, JOINED).to_numpy(zero_copy_only=False) & ~pc.match_substring(pieces, "<|").to_numpy(zero_copy_only=False)
        data, at = bytes_of(pieces.filter(pa.array(plain)))
        cuts = at[np.append(np.arange(0, len(at) - 1, JOIN), len(at) - 1)].tolist()
        joined = [data[i:j].tobytes().decode() for i, j in zip(cuts, cuts[1:])]
        found = self.library.encode_batch_fast(joined + pieces.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)
        parts = [np.array(e.ids, np.uint32) for e in found]
        ids = np.concatenate([*parts, np.empty(0, np.uint32)])
        n_joined = sum(map(len, parts[: len(joined)]))
        stops = np.searchsorted(np.cumsum(self.n_bytes[ids[:n_joined]]), at, side="right")
        lens, first = np.empty(len(pieces), np.int64), np.empty(len(pieces), np.int64)
        lens[plain], first[plain] = np.diff(stops), stops[:-1]
        lens[~plain] = [len(p) for p in parts[len(joined) :]]
        first[~plain] = n_joined + np.cumsum(lens[~plain]) - lens[~plain]
        return ids if plain.all() else ids[spread(first, lens)], lens


@lru_cache(maxsize=4)
def library_encoder(path: str | None) -> LibraryEncoder:
    return LibraryEncoder(path)


# The operator.


def _cuts(docs: DataFrame, shards: int | None) -> list[float]:
    """Ascending doc_ids that part the shards; one that holds several quantiles is there several times."""
    if not shards:
        shards = min(MOST_SHARDS, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(docs.inputFiles())))
    return sorted(docs.where("doc_id is not null").approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.2 / shards)) if shards > 1 else []


def _shard(doc_ids: pa.Array, ids: pa.Array, cuts: list[float]) -> np.ndarray:
    at = pc.fill_null(doc_ids.cast(pa.float64(), safe=False), -np.inf).to_numpy(zero_copy_only=False)
    low, high = np.searchsorted(cuts, at, side="left"), np.searchsorted(cuts, at, side="right")
    for i in np.flatnonzero(high - low > 1).tolist():
        high[i] = low[i] + 1 + zlib.crc32(ids[i].as_buffer()) % (high[i] - low[i])
    return high.astype(np.int32)


def _ended(ids: np.ndarray, ends: np.ndarray, wide: bool) -> pa.Array:
    """The ids of each text as bytes, the end id after them."""
    n, borders = len(ends) - 1, ends + np.arange(len(ends))
    out = np.full(len(ids) + n, END_ID, "<u4" if wide else "<u2")
    of_text = np.ones(len(out), bool)
    of_text[borders[1:] - 1] = False
    out[of_text] = ids
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((borders * out.itemsize).astype(np.int32)), pa.py_buffer(out)])


def write(docs: DataFrame, folder: str, path: str | None = None, shards: int | None = None) -> list[tuple[int, int, int, str]]:
    """Writes the shard files of documents into a folder: (shard, documents, ids, file) of each, in ascending doc_id order."""
    spark = docs.sparkSession
    bounded_batches(spark)
    cuts = _cuts(docs, shards)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = library_encoder(path)
        wide = e.size > 1 << 16
        for b in batches:
            doc_ids, ids = b.column("doc_id").cast(pa.int64()), _ended(*e.encode_texts(b.column("text")), wide)
            yield pa.record_batch([doc_ids, ids, pa.array(np.full(len(ids), wide)), pa.array(_shard(doc_ids, ids, cuts))], names=["doc_id", "ids", "wide", "shard"])

    encoded = docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids binary, wide boolean, shard int")
    dealt = encoded.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")
    run = uuid.uuid4().hex
    rows = dealt.mapInPandas(lambda batches: _store(batches, folder, run), "shard int, n_docs long, n_ids long, file string").collect()  # one row per file
    # What repeated attempts of this run left behind goes; other files are none of its business.
    known = {r[3] for r in rows}
    files, at = _at(folder)
    for f in files.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
        if f"-{run}-" in f.base_name and f.base_name not in known:
            files.delete_file(f.path)
    return sorted((r[0], r[1], r[2], r[3]) for r in rows)


def _store(batches: Iterator[pd.DataFrame], folder: str, run: str = "") -> Iterator[pd.DataFrame]:
    """Sorted rows into one file per shard, under names of this run and attempt."""
    now, at, file, done = None, None, "", []
    for b in batches:
        for shard, part in b.groupby("shard", sort=False):
            if shard != at:
                if now:
                    done.append((at, *now.close(), file))
                at, file = int(shard), f"shard-{int(shard):06d}-{run}-{uuid.uuid4().hex}.pfor"
                now = Writer(f"{folder}/{file}")
            ids = [np.frombuffer(x, "<u4" if w else "<u2").astype(np.int64) for x, w in zip(part["ids"], part["wide"])]
            now.add(part["doc_id"].fillna(0).to_numpy(np.int64), part["doc_id"].isna().to_numpy(), ids)
    if now:
        done.append((at, *now.close(), file))
    yield pd.DataFrame(done, columns=["shard", "n_docs", "n_ids", "file"])


def read(spark, folder: str, manifest: list[tuple[int, int, int, str]], digest: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and the ids, or their crc32, of every document of the files."""
    rows, before = [], 0
    for _, _, n, file in manifest:
        rows.append((file, before))
        before += n
    places = spark.createDataFrame(rows, "file string, before long").repartition(max(1, len(rows)), "file")
    last = "ids_crc32 long" if digest else "ids array<int>"

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, start in zip(b["file"], b["before"]):
                r = Reader(f"{folder}/{file}")
                for k, j, ids in r.documents():
                    out = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids] if digest else [x.astype(np.int32) for x in ids]
                    ids_of = pd.array(r.doc_ids[k:j], dtype="Int64")
                    ids_of[r.nulls[k:j]] = pd.NA
                    yield pd.DataFrame({"doc_id": ids_of, "start": start + r.starts[k:j], "n_tokens": np.diff(r.starts[k : j + 1]), last.split()[0]: out})

    return places.mapInPandas(load, f"doc_id long, start long, n_tokens long, {last}")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes documents to files in the shared folder, and from those files: doc_id, start, n_tokens, ids_crc32."""
    folder = Staging(docs.sparkSession, "tokens").root
    return read(docs.sparkSession, folder, write(docs, folder, path), digest=True)
