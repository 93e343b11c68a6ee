"""Best-fit packing of tokenised documents with a swap-based local search.

Texts are tokenised once and their ids written; only (row, doc_id, piece, length) goes on to the search, and each
piece's ids are joined back to its place by its row number.  Pieces of a full sequence stand alone.
The others are dealt by a hash of their key into pools of about ``pool_docs`` documents, each packed within one task:
best fit by falling length, then a local search that exchanges pieces one for one, two for one, or moves them between
underfull sequences whenever the sum of squared fills grows, which empties sequences; ``group_bins`` of them, of like
fill, meet at a time, until no exchange is left among them.  The pieces of each pool's sequences below ``open_fill`` go to
a second, far smaller deal where they meet other pools' pieces.  Pools and groups bound memory and time of a task; what they
cost in sequences is in the README.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.llm.common import by_size, narrowed, pool_of, small_batches, table, written
from motionframe.llm.tokens import WORDS, encoder

CAPACITY = 4096
POOL_DOCS = 60_000
GROUP_BINS = 400
OPEN_FILL = 0.97
FACTS = "row long, doc_id long, piece int, start long, length long, ids binary"
SEARCHED = "row long, doc_id long, piece int, length long"
PACKED = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, sequence_id long, offset long"


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    tokenizer: str = "word_bpe_49k.json", end_id: int = 1, spaceless: bool = True, words: int = WORDS,
) -> DataFrame:
    """Each document's ids and end_id, cut every ``capacity`` ids where there are more: row, doc_id, piece, start, length, ids.

    words: how many words a worker remembers.  row numbers the pieces; ids are little-endian uint16 where the vocabulary allows (``id_type``), else uint32.
    """
    kind = id_type(tokenizer, end_id, spaceless)
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokens = encoder(tokenizer, spaceless, words)
        row = TaskContext.get().partitionId() << 33
        for b in it:
            for texts in by_size(b):
                out = []
                for doc_id, own in zip(texts.column(0).to_pylist(), map(tokens.encode, texts.column(1).to_pylist()), strict=True):
                    ids = np.append(own, np.uint32(end_id)).astype(kind)
                    for k, s in enumerate(range(0, len(ids), capacity)):
                        part = ids[s : s + capacity]
                        out.append((row, doc_id, k, s, len(part), part.tobytes()))
                        row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    small_batches(docs.sparkSession)
    return narrowed(docs, id_col, text_col).mapInArrow(cut, FACTS)


def id_type(tokenizer: str, end_id: int, spaceless: bool) -> str:
    return "<u2" if max(encoder(tokenizer, spaceless).tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: by falling length, each item into the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # room sizes that some bin has, sorted
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        k = bisect_left(rooms, n)
        if k == len(rooms):
            b, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[k]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(k)
        bins[b].append(i)
        left = room - n
        if not by_room[left]:
            insort(rooms, left)
        by_room[left].append(b)
    return bins


def local_search(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Moves and exchanges between underfull bins while the sum of squared fills grows; empty bins go.

    A donor is an emptier bin, a taker a fuller one with room.  What makes the taker's fill reach the donor's and more
    adds to the sum of squares: a donor's item alone (move), for a smaller item of the taker (one for one), or two of
    the donor's items for one of the taker's (two for one).  The exchange that leaves the taker least room is made.
    Each adds to the sum of squares, which is bounded, so the search ends by itself.
    """
    fill = [sum(lengths[i] for i in b) for b in bins]
    changed = True
    while changed:
        order = sorted((b for b in range(len(bins)) if 0 < fill[b] < capacity), key=lambda b: (fill[b], b))
        changed = False
        for place, donor in enumerate(order):
            for taker in reversed(order[place + 1 :]):
                room = capacity - fill[taker]
                if not room or not bins[donor]:
                    continue
                best, move = 0, None
                mine = sorted(bins[donor], key=lambda i: (lengths[i], i))
                sizes = [lengths[i] for i in mine]
                theirs = sorted(bins[taker], key=lambda i: (lengths[i], i))
                for give in [None, *theirs]:
                    back = lengths[give] if give is not None else 0
                    k = bisect_right(sizes, room + back) - 1
                    if k >= 0 and sizes[k] - back > best:
                        best, move = sizes[k] - back, ((mine[k],), give)
                    if give is not None:
                        for j in range(len(mine)):
                            k = bisect_right(sizes, room + back - sizes[j]) - 1
                            k -= k == j
                            if k > j and sizes[k] + sizes[j] - back > best:
                                best, move = sizes[k] + sizes[j] - back, ((mine[j], mine[k]), give)
                    if best == room:
                        break
                if move and best > 0 and fill[taker] + best > fill[donor]:
                    out, give = move
                    for i in out:
                        bins[donor].remove(i)
                        bins[taker].append(i)
                    if give is not None:
                        bins[taker].remove(give)
                        bins[donor].append(give)
                    fill[taker] += best
                    fill[donor] -= best
                    changed = True
    return [b for b in bins if b]


def pack(lengths: list[int], capacity: int, group_bins: int = GROUP_BINS) -> list[list[int]]:
    """Best fit, then the search over all underfull bins, ``group_bins`` at a time from the emptiest on."""
    bins = best_fit(lengths, capacity)
    fill = [sum(lengths[i] for i in b) for b in bins]
    full = [b for b, f in zip(bins, fill, strict=True) if f == capacity]
    under = [b for f, b in sorted(((f, b) for b, f in zip(bins, fill, strict=True) if f < capacity))]
    # the emptiest bins meet in one group, since their items can still empty some
    for s in range(0, len(under), group_bins):
        full += local_search(under[s : s + group_bins], lengths, capacity)
    return full


def best_fit_packing(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    tokenizer: str = "word_bpe_49k.json", end_id: int = 1, spaceless: bool = True,
    pool_docs: int = POOL_DOCS, open_fill: float = OPEN_FILL, group_bins: int = GROUP_BINS, words: int = WORDS,
) -> DataFrame:
    """doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset: one row for each piece, sequences gapless from 0.

    ids are the piece's ids as little-endian uint32: those of a sequence's pieces, by offset, are the packed sequence.
    A null or empty text is one piece of end_id alone.  Only documents of more than ``capacity`` ids are cut; long texts are
    packed whole, piece by piece.  Rows that repeat are packed as often as they come, those without id too; of pieces of one
    length any may come first.  An empty table gives an empty result; other columns are ignored.
    """
    whole = placed(docs, id_col, text_col, capacity, tokenizer, end_id, spaceless, pool_docs, open_fill, group_bins, words)
    kind = id_type(tokenizer, end_id, spaceless)

    def widened(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ids = [np.frombuffer(x, kind).astype("<u4").tobytes() for x in b.column("ids").to_pylist()]
            cols = [*b.columns[:4], pa.array(ids, pa.binary()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), *b.columns[5:]]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids", "ids_crc32", "sequence_id", "offset"])

    return whole.mapInArrow(widened, PACKED)


def placed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    tokenizer: str = "word_bpe_49k.json", end_id: int = 1, spaceless: bool = True,
    pool_docs: int = POOL_DOCS, open_fill: float = OPEN_FILL, group_bins: int = GROUP_BINS, words: int = WORDS,
) -> DataFrame:
    """doc_id, piece, start, length, ids (as ``id_type`` says), sequence_id, offset: the pieces in their sequences."""
    cut = written(pieces(docs, id_col, text_col, capacity, tokenizer, end_id, spaceless, words), "pieces")
    searched = cut.select("row", "doc_id", "piece", "length")
    schema = f"{SEARCHED}, sequence_id long, offset long"

    def deal(rows: DataFrame, level: int) -> DataFrame:
        n = sized_pools(rows.count(), pool_docs)

        def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            held = [b for b in it if b.num_rows]
            if not held:
                return
            t = pa.Table.from_batches(held).sort_by([("doc_id", "ascending"), ("piece", "ascending"), ("length", "ascending"), ("row", "ascending")]).combine_chunks()
            lengths = t.column("length").to_pylist()
            seq, off = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            base = (level << 60) + (TaskContext.get().partitionId() << 32)
            for k, items in enumerate(pack(lengths, capacity, group_bins)):
                at = 0
                for i in items:
                    seq[i], off[i] = base + k, at
                    at += lengths[i]
            yield from t.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off)).to_batches()

        # the row number spreads rows that repeat; it is the same when a task runs again
        dealt = rows.select(*rows.columns, pool_of("row", pools=n).alias("pool")).repartitionById(n, F.col("pool"))
        return dealt.drop("pool").mapInArrow(task, schema)

    first = written(deal(searched.where(F.col("length") < capacity), 0), "packed")
    fills = first.groupBy("sequence_id").agg(F.sum("length").alias("filled")).where(F.col("filled") < open_fill * capacity)
    loose = written(first.join(fills.select("sequence_id"), "sequence_id", "left_semi").select(*searched.columns), "loose")
    place = ("row", "sequence_id", "offset")
    kept = first.join(fills.select("sequence_id"), "sequence_id", "left_anti").select(*place)
    # a full piece's sequence is known by its row number
    alone = searched.where(F.col("length") == capacity).select("row", (F.col("row") + F.lit(1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = written(kept.unionByName(deal(loose, 1).select(*place)).unionByName(alone), "places")
    return cut.join(places.hint("shuffle_hash"), "row").select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")


def sized_pools(rows: int, per_pool: int) -> int:
    return max(1, -(-rows // per_pool))


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """The packed pieces, with a crc32 of their ids instead of these: they are widened and summed where they lie."""
    kind = id_type("word_bpe_49k.json", 1, True)

    def summed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            crc = [zlib.crc32(np.frombuffer(x, kind).astype("<u4")) for x in b.column("ids").to_pylist()]
            yield b.drop_columns(["ids"]).append_column("ids_crc32", pa.array(crc, pa.int64()))

    out = placed(table(spark, sf_dir, "documents"))
    return out.mapInArrow(summed, PACKED.replace("ids binary, ids_crc32 long, ", "") + ", ids_crc32 long")
