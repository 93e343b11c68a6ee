"""Removal of long repeated byte strings by a distributed difference-cover suffix sort.

A 200-byte string can only stand twice where its anchor - the least hashed 40-byte string in it - stands twice at the
same offset.  So suffixes needn't be sorted all together: they are dealt by anchor.

1. One scan notes each text's digest, and per anchor its hash, the range of its offset in the strings it anchors, and a
   hash of its context: all bytes of those strings.  Equal contexts within a text are settled there.
2. Texts that are copies of another are settled by their digest.  Of the others, anchors that stand once go; those with
   equal contexts are settled, and one of each kind stays as a witness for contexts that differ.
3. Contexts that share an anchor are cut from the texts.  Those of a small group are sorted together by difference cover
   (``suffix_array``), and strings whose neighbour has the same 200-byte prefix are repeated.
4. A group of more than ``GROUP`` contexts is split: its strings by halves of their range of offsets, each half dealt
   anew by the bytes that all its strings share, equal contexts settled first, at most eight times, when one string is
   left in each context.  No task gets a group that grows with the data.
5. Each text's settled strings are merged and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.llm.anchors import GRAM, WINDOW, anchors
from motionframe.llm.common import release_shuffles, runs, small_batches, table, written
from motionframe.llm.shingles import mix, raw
from motionframe.llm.suffix_array import repeated

GROUP = 64
SORTED_BYTES = 700_000
WIDEST = WINDOW - GRAM
SPANS = "key long, start long, end long"


def text_digest(text) -> F.Column:
    """The whole sha256 of the text: rows of equal digest are one text.  Where it matters once only, texts get numbers (key)."""
    return F.unhex(F.sha2(text, 256))


def packed(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return at << 16 | low << 8 | high


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans joined where they overlap or touch."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    return start[new], end[np.concatenate([new[1:], [True]])]


def noted(docs: DataFrame) -> DataFrame:
    """docs' doc_id and digest, n_bytes, and arrays: gram, context, place of each anchor; start, end of spans settled within the text."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, ends = raw(b.column("text"))
            cols: list[list] = [[], [], [], [], []]
            for i, j in zip(ends[:-1], ends[1:], strict=True):
                at, gram, low, high, context = anchors(data[i:j])
                _, first, which, times = np.unique(gram + mix(context.copy()), return_index=True, return_inverse=True, return_counts=True)
                twice = times[which] > 1
                s, e = merged((at - high)[twice], (at - low + WINDOW)[twice])
                first = np.sort(first)
                for c, v in zip(cols, (gram[first].view(np.int64), context[first].view(np.int64), packed(at, low, high)[first], s, e), strict=True):
                    c.append(v)
            arrays = [pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in c])]), np.concatenate(c).astype(np.int64)).cast(pa.list_(pa.int64())) if c else pa.array([], pa.list_(pa.int64())) for c in cols]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("digest"), pa.array(np.diff(ends)), *arrays], names=["doc_id", "digest", "n_bytes", "gram", "context", "place", "start", "end"])

    lists = ", ".join(f"{c} array<long>" for c in ("gram", "context", "place", "start", "end"))
    return docs.mapInArrow(task, f"doc_id long, digest binary, n_bytes long, {lists}")


def contexts(texts: DataFrame) -> DataFrame:
    """(anchor, size, key, at, low, high, first, last, bytes) of (key, text, wanted): the contexts cut from each text."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for key, text, wanted in zip(b.column("key").to_pylist(), b.column("text"), b.column("wanted").to_pylist(), strict=True):
                data = text.as_py().encode()
                for w in wanted:
                    at, low, high = w["place"] >> 16, w["place"] >> 8 & 255, w["place"] & 255
                    out.append((w["gram"], w["size"], key, at, low, high, 0, WIDEST, data[at - high : at - low + WINDOW]))
            yield context_batch(out)

    return texts.select("key", "text", "wanted").mapInArrow(task, "anchor long, size long, key long, at long, low long, high long, first long, last long, bytes binary")


CONTEXT = ["anchor", "size", "key", "at", "low", "high", "first", "last", "bytes"]


def context_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 8 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=CONTEXT)


def spans_batch(key, start, end) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in (key, start, end)], names=["key", "start", "end"])


def sorted_groups(rows: DataFrame) -> DataFrame:
    """(key, start, end): spans of repeated strings in groups (anchor, ...) of contexts, groups sorted some at a time."""

    def settle(tables: list[pa.Table]) -> pa.RecordBatch:
        t = pa.concat_tables(tables)
        texts = t.column("bytes").to_pylist()
        begin = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])
        data = np.empty(begin[-1], np.int64)
        valid = np.zeros(begin[-1], bool)
        for i, x in enumerate(texts):
            data[begin[i] : begin[i + 1] - 1] = np.frombuffer(x, np.uint8)
            data[begin[i + 1] - 1] = 256
            valid[begin[i] : begin[i + 1] - WINDOW] = True
        hit = np.flatnonzero(repeated(data + 1, valid, WINDOW))
        row = np.searchsorted(begin, hit, "right") - 1
        at, high = t.column("at").to_numpy(), t.column("high").to_numpy()
        start = at[row] - high[row] + hit - begin[row]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)]) if len(hit) else np.empty(0, bool)
        ends = np.concatenate([new[1:], [True]]) if len(hit) else new
        return spans_batch(t.column("key").to_numpy()[row[new]], start[new], start[ends] + WINDOW)

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for t in runs(it):
            held.append(t)
            n += sum(len(x) + 1 for x in t.column("bytes").to_pylist())
            if n > SORTED_BYTES:
                yield settle(held)
                held, n = [], 0
        if held:
            yield settle(held)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("anchor", "key", "at", "high", "bytes").repartition(parts, "anchor").sortWithinPartitions("anchor", "key", "at")
    return dealt.mapInArrow(task, SPANS)


def halves(rows: DataFrame) -> DataFrame:
    """The contexts of both halves of each range of offsets, dealt by the bytes that all strings of a half share."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out, shared = [], []
            for _, _, key, at, low, high, first, last, data in zip(*(b.column(c).to_pylist() for c in CONTEXT), strict=True):
                middle = (first + last) // 2
                for a, z in ((first, middle), (middle + 1, last)):
                    lo, hi = max(low, a), min(high, z)
                    if lo <= hi and a <= z:
                        part = data[high - hi : high - lo + WINDOW]  # strings of offsets lo to hi
                        core = part[hi - a : hi - z + WINDOW]
                        shared.append(hashlib.blake2b(core, digest_size=8, key=b"%d-%d" % (a, z)).digest())
                        out.append((0, 0, key, at, lo, hi, a, z, part))
            done = context_batch(out)
            yield done.set_column(0, "anchor", pa.array(np.frombuffer(b"".join(shared), "<i8")))

    return rows.select(*CONTEXT).mapInArrow(task, "anchor long, size long, key long, at long, low long, high long, first long, last long, bytes binary")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text: one row for each input row.

    Removed is each byte of a 200-byte string that also starts elsewhere, in any text or the same one, overlapping or
    not.  A null text is empty.  Of equal texts of 200 bytes or more nothing is left.  What is left of a text need not
    be UTF-8: kept_text is binary.  Rows that repeat, and rows without doc_id, are answered as they come.  Long texts are
    judged whole.  An empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    texts = texts.select("doc_id", "text", text_digest(F.col("text")).alias("digest"))
    facts = written(noted(texts), "anchors")
    # one row of each text speaks for its copies; key is the text's number
    reps = facts.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"))
    reps = written(reps.withColumn("key", F.monotonically_increasing_id()), "texts")
    spans = removed_spans(texts, facts, reps)
    own = spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    release_shuffles(docs.sparkSession)
    few = written(reps.select("digest", "copies", "key").join(own, "key", "left").where("copies > 1 OR spans IS NOT NULL").drop("key"), "removed")
    release_shuffles(docs.sparkSession)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for doc_id, text, copies, spans in zip(b.column("doc_id").to_pylist(), b.column("text"), b.column("copies").to_pylist(), b.column("spans").to_pylist(), strict=True):
                data = text.as_py().encode()
                if (copies or 1) > 1 and len(data) >= WINDOW:
                    start, end = np.array([0]), np.array([len(data)])
                else:
                    start, end = merged(*(np.array([s[c] for s in spans or []], np.int64) for c in ("start", "end")))
                left = b"".join(data[i:j] for i, j in zip([0, *end], [*start, len(data)], strict=True))
                out.append((doc_id, len(data), len(data) - len(left), len(start), hashlib.sha256(left).hexdigest(), left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return texts.join(few, "digest", "left").select("doc_id", "text", "copies", "spans").mapInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"
    )


def removed_spans(texts: DataFrame, facts: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, start, end): spans of repeated strings, but for those that texts share with their copies."""
    numbers = reps.select("digest", F.col("doc_id").alias("rep"), "key")
    one = facts.join(numbers, "digest").where(F.col("doc_id").eqNullSafe(F.col("rep")))
    within = one.select("key", F.explode(F.arrays_zip("start", "end")).alias("s")).select("key", "s.start", "s.end").distinct()
    rows = one.select("key", F.explode(F.arrays_zip("gram", "context", "place")).alias("a")).select("key", "a.gram", "a.context", "a.place")
    shared = written(rows.groupBy("gram").count().where("count > 1").select("gram"), "shared-anchors")
    rows = written(rows.join(shared, "gram", "left_semi"), "anchor-rows")
    kinds = written(rows.groupBy("gram", "context").agg(F.count("*").alias("times"), F.min(F.struct("key", "place")).alias("one")), "contexts")
    alike = rows.join(written(kinds.where("times > 1").select("gram", "context"), "alike"), ["gram", "context"], "left_semi")
    at, low, high = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255), F.col("place").bitwiseAND(255)
    found = [within, alike.select("key", (at - high).alias("start"), (at - low + WINDOW).alias("end"))]

    sizes = written(kinds.groupBy("gram").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    wanted = kinds.join(sizes, "gram").select("one.key", F.struct("gram", "size", "one.place").alias("w")).groupBy("key").agg(F.collect_list("w").alias("wanted"))
    wanted = written(wanted.join(numbers, "key"), "wanted")
    source = texts.join(wanted, "digest").where(F.col("doc_id").eqNullSafe(F.col("rep"))).dropDuplicates(["key"])
    cut = written(contexts(source), "cut-contexts")
    release_shuffles(texts.sparkSession)
    found.append(written(sorted_groups(cut.where(F.col("size") <= GROUP)), "spans"))
    large = cut.where(F.col("size") > GROUP)
    width = WIDEST + 1
    while width > 1 and not large.isEmpty():
        width = -(-width // 2)
        parts = written(halves(large), "halves")
        ident = ["anchor", "low", "high", "bytes"]
        hashed = parts.withColumn("c", F.xxhash64(*ident)).withColumn("d", F.hash(*reversed(ident)))
        times = written(hashed.groupBy("anchor", "c", "d").agg(F.count("*").alias("times"), F.min(F.struct("key", "at", "low", "high")).alias("one")), "times")
        twice = written(times.where("times > 1").select("anchor", "c", "d"), "twice")
        settled = hashed.join(twice, ["anchor", "c", "d"], "left_semi")
        found.append(written(settled.select("key", (F.col("at") - F.col("high")).alias("start"), (F.col("at") - F.col("low") + WINDOW).alias("end")), "spans"))
        if width == 1:
            break
        sizes = written(times.groupBy("anchor").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
        ones = written(times.select("anchor", "c", "d", "one.key", "one.at"), "ones")
        left = hashed.drop("size").join(ones, ["anchor", "c", "d", "key", "at"], "left_semi").join(sizes, "anchor").select(*CONTEXT)
        left = written(left, "witnesses")
        found.append(written(sorted_groups(left.where(F.col("size") <= GROUP)), "spans"))
        large = left.where(F.col("size") > GROUP)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


SQL = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h FROM documents),
c AS (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 199, 500)) AS c FROM d),
p AS (SELECT doc_id, c, substr(h, 2 * c + 1, 1398) AS part FROM c),
w AS (SELECT doc_id, c, part, unnest(range(0, len(part) // 2 - 199)) AS j FROM p),
k AS MATERIALIZED (SELECT doc_id, c + j AS i, md5_number(substr(part, 2 * j + 1, 400)) AS m FROM w),
g AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before
  FROM k WHERE m IN (SELECT m FROM k GROUP BY m HAVING count(*) > 1)),
n AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM g),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS z FROM n GROUP BY doc_id, r),
e AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM s),
t AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head
  FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
