"""Token ids in fixed-width bit-packed files.

File: blocks of ``block_ids`` ids, each id in the fewest bits that hold the vocabulary, a block starting at a byte;
then the block offsets (uint64), then for each document its doc_id (int64), whether it has one (uint8) and its first
id's place (uint64, one more at the end), then an 8-number uint64 footer.  Any id range is read by fetching only its
blocks and unpacking them with numpy.  Files are named by their place in doc_id order and put there by renaming, so a
task that runs again leaves the same file.  Their number follows the bytes of the texts.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.llm.common import by_size, fresh_path, narrowed, small_batches, table
from motionframe.llm.tokens import encoder

MAGIC = 0x3154494253444954
BLOCK_IDS = 1 << 14
FOOTER = np.dtype("<u8")
SHARD_BYTES = 128 << 20
DOC_BYTES = 64  # what a document counts besides its text, so that files of empty texts are bounded too
MOST_ACCURACY = 1_000_000  # of the quantiles between files; a file may be off its size by a millionth of all documents
NO_ID = -(1 << 63)
READ_DOCS = 10_000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Lowest bit first; the last byte is filled up with zeros."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    one = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(one.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    one = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = one
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(n)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def put(fs: pafs.FileSystem, temp: str, name: str) -> None:
    """Rename temp to name; where another attempt's file, which has the same bytes, is there already, it stays."""
    try:
        fs.move(temp, name)
    except OSError:
        if fs.get_file_info(name).type != pafs.FileType.File:
            raise
        fs.delete_file(temp)


class ShardWriter:
    """Holds one block of ids and the documents' places; memory doesn't follow the ids."""

    def __init__(self, out, bits: int, block_ids: int = BLOCK_IDS):
        self.out, self.bits, self.block_ids = out, bits, block_ids
        self.held: list[np.ndarray] = []
        self.n_held = self.n_ids = self.at = 0
        self.offsets, self.docs, self.valid, self.starts = array("Q"), array("q"), bytearray(), array("Q")

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(0 if doc_id is None else doc_id)
        self.valid.append(doc_id is not None)
        self.starts.append(self.n_ids)
        self.n_ids += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            self.flush(False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, "<u4")
        end = len(ids) if last else len(ids) - len(ids) % self.block_ids
        for s in range(0, end, self.block_ids):
            data = pack(ids[s : min(s + self.block_ids, end)], self.bits)
            self.offsets.append(self.at)
            self.out.write(data)
            self.at += len(data)
        self.held, self.n_held = [ids[end:].copy()], len(ids) - end

    def close(self) -> None:
        self.flush(True)
        self.starts.append(self.n_ids)
        for values in (self.offsets, self.docs, self.valid, self.starts):
            self.out.write(bytes(values) if isinstance(values, bytearray) else values.tobytes())
        self.out.write(np.array([MAGIC, self.bits, self.block_ids, self.n_ids, len(self.docs), len(self.offsets), self.at, 1], FOOTER).tobytes())


class ShardReader:
    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - 64)
        magic, self.bits, self.block_ids, self.n_ids, n, blocks, self.at, _ = map(int, np.frombuffer(file.read(64), FOOTER))
        if magic != MAGIC:
            raise ValueError("not a packed id file")
        file.seek(self.at)
        index = file.read(size - 64 - self.at)
        self.offsets = np.frombuffer(index, "<u8", blocks)
        self.docs = np.frombuffer(index, "<i8", n, 8 * blocks)
        self.valid = np.frombuffer(index, "u1", n, 8 * (blocks + n)).astype(bool)
        self.starts = np.frombuffer(index[8 * (blocks + n) + n :], "<u8", n + 1).astype(np.int64)

    def ids(self, start: int, end: int) -> np.ndarray:
        """ids start to end - 1 of the file, from their blocks alone."""
        if end <= start:
            return np.empty(0, "<u4")
        a, b = start // self.block_ids, -(-end // self.block_ids)
        at, to = int(self.offsets[a]), int(self.offsets[b]) if b < len(self.offsets) else self.at
        self.file.seek(at)
        data, out = self.file.read(to - at), []
        for k in range(a, b):
            n = min(self.block_ids, self.n_ids - k * self.block_ids)
            out.append(unpack(data[int(self.offsets[k]) - at :][: -(-n * self.bits // 8)], n, self.bits))
        return np.concatenate(out)[start - a * self.block_ids : end - a * self.block_ids]

    def documents(self, about: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(place in the file, ids) of each document, some blocks at a time."""
        i, n = 0, len(self.docs)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + about, "right")) - 1)
            j = min(j, n)
            part = self.ids(int(self.starts[i]), int(self.starts[j]))
            for k in range(i, j):
                yield k, part[self.starts[k] - self.starts[i] : self.starts[k + 1] - self.starts[i]]
            i = j


@dataclass(frozen=True)
class Shards:
    """path: the folder; files: (name, documents, ids) in doc_id order."""

    path: str
    files: list[tuple[str, int, int]]


def write_shards(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json",
    end_id: int = 0, spaceless: bool = False, block_ids: int = BLOCK_IDS, shards: int | None = None,
) -> Shards:
    """Tokenise whole texts, append end_id to each and write them in ascending doc_id order.

    A null text is empty: its document has end_id alone.  Rows without doc_id come first; equal ids stand together, and so
    do rows that repeat, in no set order.  Long texts are encoded whole.  An empty table gives no files; other columns are
    ignored.  Files are of about SHARD_BYTES of text, or fewer where that would leave tasks idle.  Bounds between them are
    quantiles of doc_id alone, so texts are moved once; one doc_id, or none, that fills several files is dealt over them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = narrowed(docs, id_col, text_col)
    size = 0 if shards else rows.agg(F.sum(F.octet_length("text") + F.lit(DOC_BYTES))).head()[0] or 0
    n = shards or max(1, -(-size // SHARD_BYTES), min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // (SHARD_BYTES // 64)))
    number = F.coalesce("doc_id", F.lit(NO_ID))
    shares = F.array(*[F.lit((i + 1) / n) for i in range(n - 1)] or [F.lit(0.5)]) if n < 1000 else F.expr(f"transform(sequence(1, {n - 1}), i -> i / {n}D)")
    cuts = rows.select(F.percentile_approx(number, shares, min(20 * n, MOST_ACCURACY))).head()[0] or []
    cuts = np.sort(np.array(cuts[: n - 1], np.int64))  # bounds that are equal leave files to one doc_id alone
    path = fresh_path(spark, "token-ids")

    def encode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(tokenizer, spaceless)
        schema = pa.schema([("shard", pa.int32()), ("doc_id", pa.int64()), ("ids", pa.binary())])
        for b in it:
            for part in by_size(b):
                doc_ids, texts = (part.column(i).to_pylist() for i in (0, 1))
                held = []
                for doc_id, text, ids in zip(doc_ids, texts, map(tokens.encode, texts), strict=True):
                    own = NO_ID if doc_id is None else doc_id
                    shard, last = int(np.searchsorted(cuts, own, "left")), int(np.searchsorted(cuts, own, "right")) - 1
                    if last > shard:
                        shard += zlib.crc32(text.encode()) % (last - shard + 1)
                    held.append((shard, doc_id, ids.astype("<u2").tobytes() if narrow else ids.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    vocabulary = encoder(tokenizer, spaceless).tokenizer.get_vocab_size()
    bits = bits_for(max(vocabulary, end_id + 1))
    narrow = bits <= 16

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        writer = shard = None
        done = []
        for b in it:
            for s, doc_id, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if writer is None:
                    shard, name = s, f"{root}/part-{s:06d}.ids"
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(temp := f"{root}/.{s:06d}-{uuid.uuid4().hex}")
                    writer = ShardWriter(out, bits, block_ids)
                ids = np.frombuffer(data, "<u2" if narrow else "<u4").astype("<u4")
                writer.add(doc_id, np.append(ids, np.uint32(end_id)).astype("<u4"))
        if writer is not None:
            writer.close()
            out.close()
            put(fs, temp, name)
            done.append((shard, len(writer.docs), writer.n_ids))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.int64()) for i in range(3)], names=["shard", "docs", "ids"])

    files = (
        rows.mapInArrow(encode, "shard int, doc_id long, ids binary")
        .repartitionById(len(cuts) + 1, F.col("shard"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
        .mapInArrow(write, "shard long, docs long, ids long")
        .collect()  # one row for each file
    )
    return Shards(path, [(f"part-{s:06d}.ids", d, i) for s, d, i in sorted(map(tuple, files))])


def read_shards(spark, shards: Shards) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read from the files; start counts the ids of all documents before."""
    path, at, rows = shards.path, 0, []
    for name, _, ids in shards.files:
        rows.append((name, at))
        at += ids

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(path)
        for b in it:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    shard = ShardReader(f)
                    crc: list[int] = []
                    for k, ids in shard.documents():
                        crc.append(zlib.crc32(ids))
                        if len(crc) == READ_DOCS or k + 1 == len(shard.docs):
                            at = slice(k + 1 - len(crc), k + 1)
                            starts = shard.starts[at.start : k + 2]
                            cols = [pa.array(shard.docs[at], pa.int64(), mask=~shard.valid[at]), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())]
                            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])
                            crc = []

    files = spark.createDataFrame(rows, "name string, base long").repartition(max(1, len(rows)))
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_output(spark, sf_dir: str) -> DataFrame:
    return read_shards(spark, write_shards(table(spark, sf_dir, "documents")))
