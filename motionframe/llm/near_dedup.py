"""Near-duplicate detection by a chosen-path set similarity join over MinHash signatures.

1. One scan turns each text into its set of five-word shingles and keeps doc_id, set size, a 128-bit fingerprint of
   the set and ``COORDINATES`` minwise tokens.  Documents of equal sets go on as one representative, known by a
   number (``rep``), since rows of one doc_id may have unlike texts.
2. Independent trees, as many as the threshold needs (``trees_at``), branch the representatives: a node picks one of the
   coordinates (at times two, so that a pair at the threshold is expected to survive each level) by a hash of its own
   path, and its members part by their minwise token there.  A node of at most ``NODE`` members is compared exhaustively
   on the signatures; a larger one branches again, until ``DEPTH``.
3. Of the pairs that a node finds alike, first only those of each group's leader - the set that most others are like -
   are confirmed, on full sets: these stars join most of a group of copies at the cost of one set for each member.
   Groups that are joined are done.  In others, alike pairs that no link joins are confirmed one by one where they are few
   for the group's size: a chain of documents that share passages costs its neighbours' pairs, not all pairs of the chain.
   Dense groups, and nodes still large at ``DEPTH``, gather into families, whose members' sets are compared by pairs of
   blocks within tasks, which report links alone; what the family's largest component has joined isn't compared within.
4. The components of the confirmed links, and of links between the sets that share a doc_id, are the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.llm.common import by_size, narrowed, runs, small_batches, table, written
from motionframe.llm.components import components
from motionframe.llm.shingles import U, mix, shingle_sets

PERCENT = 85
COORDINATES = 128
SCREEN_TREES = 6
DEPTH = 4
NODE = 128
STAR_BLOCK = 256  # sets that are compared with one leader in a task, about
BLOCK = 512  # sets of a family on each side of a comparison, about
BLOCK_SHINGLES = 2_000_000
PART = 1 << 18  # bytes of text that are hashed at once, about; at least 28 bytes of memory for each
DENSE = 4  # pairs for each member, from which on a group is dense
BROADCAST_ROWS = 1 << 20  # of 16 bytes, and as many again for their table
MISS = 1e-4
SET_HASH = U(0xC2B2AE3D27D4EB4F)


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """16 bits of the minwise token at each coordinate."""
    x, least = (s >> U(32)).astype(np.uint32), np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        np.minimum(least, (x[k : k + 512, None] * a + b).min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n, f1, f2, sig of (doc_id, text, text_key); n = 0 has no signature."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients()
        for batch in it:
            for part in by_size(batch, most=PART):
                sets = shingle_sets(part.column(1))
                f1 = np.array([s.sum(dtype=U) for s in sets], U)
                f2 = np.array([mix(s * SET_HASH).sum(dtype=U) for s in sets], U)
                sigs = [signature(s, a, b).tobytes() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(sigs, pa.binary())],
                    names=["doc_id", "text_key", "n", "f1", "f2", "sig"],
                )

    return docs.mapInArrow(task, "doc_id long, text_key long, n long, f1 long, f2 long, sig binary")


def chosen(keys: np.ndarray, sigs: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(member, child key) of each branch that nodes ``keys`` choose for their members with these signatures."""
    members, children = [], []
    for branch, share in ((1, 1.0), (2, 1 / similarity - 1)):
        picks = mix(keys ^ U(0x5851F42D4C957F2D * branch & (1 << 64) - 1))
        on = np.flatnonzero((picks >> U(11)).astype(float) / 2**53 < share) if share < 1 else np.arange(len(keys))
        place = mix(picks[on] + U(branch)) % U(COORDINATES)
        token = sigs[on, place.astype(np.int64)].astype(U)
        members.append(on)
        children.append(mix(mix(keys[on] + U(branch)) ^ (place << U(16) | token)))
    return np.concatenate(members), np.concatenate(children)


def trees_at(depth: int, similarity: float) -> int:
    """Trees whose small nodes at this depth are compared: enough that a pair at the threshold is missed by all with MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - similarity**depth)) if similarity < 1 else 1


def first_nodes(sigs: DataFrame, trees: int) -> DataFrame:
    """(tree, key, rep): the nodes of depth 1 that each representative is in."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = mix(np.arange(1, trees + 1, dtype=U) * U(0xD1B54A32D192ED03))
        place = (mix(roots + U(1)) % U(COORDINATES)).astype(np.int64)
        for b in it:
            if b.num_rows:
                s = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(-1, COORDINATES)
                keys = mix((roots + U(17))[None, :] ^ (s[:, place].astype(U) << U(20)))
                rep = np.repeat(b.column("rep").to_numpy(), trees)
                tree = np.tile(np.arange(trees, dtype=np.int32), len(s))
                yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(keys.reshape(-1).view(np.int64)), pa.array(rep)], names=["tree", "key", "rep"])

    return sigs.select("rep", "sig").mapInArrow(task, "tree int, key long, rep long")


def branched(rows: DataFrame, similarity: float) -> DataFrame:
    """(tree, key, rep) one level deeper, of (tree, key, rep, sig)."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                s = np.frombuffer(b"".join(b.column("sig").to_pylist()), "<u2").reshape(-1, COORDINATES)
                on, child = chosen(b.column("key").to_numpy().view(U), s, similarity)
                yield pa.RecordBatch.from_arrays([b.column("tree").take(pa.array(on)), pa.array(child.view(np.int64)), b.column("rep").take(pa.array(on))], names=["tree", "key", "rep"])

    return rows.select("tree", "key", "rep", "sig").mapInArrow(task, "tree int, key long, rep long")


def least_agreement(similarity: float) -> int:
    """Coordinates that a pair at the threshold agrees on, but for four standard deviations."""
    return math.floor(COORDINATES * (similarity - 4 * math.sqrt(similarity * (1 - similarity) / COORDINATES)))


def agreeing(s: np.ndarray, n: np.ndarray, t: np.ndarray, m: np.ndarray, need: int, similarity: float) -> np.ndarray:
    """Which signatures s (of sets of sizes n) and t (m) are alike enough, as a matrix; some rows at a time."""
    out = np.empty((len(s), len(t)), bool)
    for k in range(0, len(s), 64):
        out[k : k + 64] = (s[k : k + 64, None, :] == t[None, :, :]).sum(axis=2, dtype=np.int16) >= need
    return out & (np.minimum(n[:, None], m[None, :]) >= similarity * np.maximum(n[:, None], m[None, :]) - 1e-6)


def alike_in_nodes(rows: DataFrame, similarity: float) -> DataFrame:
    """(watched, a, b) of small nodes; rows (key, rep, n, sig).

    watched 0: b is alike to its group's leader a.  watched 1: set b of group a, in which more pairs are alike than those.
    """
    need = least_agreement(similarity)

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for t in runs(it):
            rep, n = t.column("rep").to_numpy(), t.column("n").to_numpy()
            s = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, COORDINATES)
            alike = np.triu(agreeing(s, n, s, n, need, similarity), 1)
            if not alike.any():
                continue
            alike |= alike.T
            left = alike.any(axis=1)
            for x in np.flatnonzero(left).tolist():
                if left[x]:
                    group, front = [x], [x]
                    left[x] = False
                    while front:
                        near = np.flatnonzero(alike[front.pop()] & left).tolist()
                        left[near] = False
                        front += near
                        group += near
                    group.sort()
                    free, stars = set(group), 0
                    degree = alike[np.ix_(group, group)].sum(axis=1)
                    for i in [group[k] for k in np.argsort(-degree, kind="stable")]:  # each leads those that are alike and have no leader yet
                        if i in free:
                            own = [j for j in group if j in free and alike[i, j]]
                            free -= {i, *own}
                            stars += len(own)
                            out += [(0, int(rep[i]), int(rep[j])) for j in own]
                    if alike[np.ix_(group, group)].sum() > 2 * stars:
                        name = int(mix(np.array([t.column("key")[0].as_py() & (1 << 64) - 1, x], U).cumsum(dtype=U))[1].view(np.int64))
                        out += [(1, name, int(rep[j])) for j in group]
            if len(out) > 20_000:
                yield triples(out)
                out = []
        yield triples(out)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "rep", "n", "sig").repartition(parts, "key").sortWithinPartitions("key", "rep")
    return dealt.mapInArrow(task, "watched int, a long, b long")


def triples(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], k) for i, k in enumerate(kinds)], names=["watched", "a", "b"])


def edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in out], pa.int64()) for i in (0, 1)], names=["a", "b"])


def candidates(sigs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Among representatives (rep, n, sig): stars (a, b); groups (name, rep) in which more pairs than those may be alike;
    and the representatives that share a first node with another."""
    trees = trees_at(DEPTH, similarity)
    screen = first_nodes(sigs, max(SCREEN_TREES, trees_at(1, similarity)))
    shared = written(screen.groupBy("key").count().where("count > 1").select("key"), "screen")
    live = written(sigs.join(screen.join(shared, "key", "left_semi").select("rep").distinct(), "rep", "left_semi"), "live")
    rows, found = written(first_nodes(live, trees), "nodes"), []
    none = live.where("false").select(F.lit(0).alias("watched"), F.col("rep").alias("a"), F.col("rep").alias("b"))
    far = none
    for depth in range(1, DEPTH + 1):
        sizes = written(rows.groupBy("key").agg(F.count("*").alias("size"), F.min("rep").alias("least")).where("size > 1"), "sizes")
        sized = rows.join(sizes, "key")
        small = sized.where((F.col("size") <= NODE) & (F.col("tree") < trees_at(depth, similarity)))
        found.append(written(alike_in_nodes(small.select("key", "rep").join(live, "rep"), similarity).distinct(), "alike"))
        large = sized.where(F.col("size") > NODE)
        if depth == DEPTH:
            far = large.select(F.lit(1).alias("watched"), F.col("key").alias("a"), F.col("rep").alias("b"))
            far = far.union(large.where("rep != least").select(F.lit(0).alias("watched"), F.col("least").alias("a"), F.col("rep").alias("b"))).distinct()
        elif sizes.where(F.col("size") > NODE).count() == 0:
            break
        else:
            rows = written(branched(large.select("tree", "key", "rep").join(live, "rep"), similarity).distinct(), "nodes")
    found.append(written(far, "large-nodes"))
    every = none
    for f in found:
        every = every.union(f)
    pair = lambda kind: every.where(F.col("watched") == kind)
    return written(pair(0).select("a", "b").distinct(), "stars"), pair(1).select(F.col("a").alias("name"), F.col("b").alias("rep")), live


def other_pairs(groups: DataFrame, joined: DataFrame, live: DataFrame, stars: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Of groups (name, rep): (a, b), alike pairs of sparse ones that neither the components ``joined`` (v, component) nor a
    star has; and (v, component): the families that dense groups gather into.

    A group whose sets are all joined already is done.  Groups of more than NODE sets count as dense.
    """
    need = least_agreement(similarity)
    own = groups.join(joined.withColumnRenamed("v", "rep"), "rep", "left").select("name", "rep", F.coalesce("component", "rep").alias("component"))
    own = written(own, "groups")
    open_ = own.groupBy("name").agg(F.count("*").alias("size"), F.min("component").alias("x"), F.max("component").alias("y"), F.min("rep").alias("least")).where("x < y")
    open_ = written(open_.select("name", "size", "least"), "open-groups")
    rows = written(own.join(open_, "name"), "open-rows")
    small = rows.where(F.col("size") <= NODE).select("name", "rep", "component").join(live, "rep")

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(it):
            rep, component, n = (t.column(c).to_numpy() for c in ("rep", "component", "n"))
            s = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, COORDINATES)
            x, y = np.nonzero(np.triu(agreeing(s, n, s, n, need, similarity) & (component[:, None] != component[None, :]), 1))
            dense = len(x) > DENSE * len(rep)
            if dense:
                x, y = np.zeros(len(rep) - 1, np.int64), np.arange(1, len(rep))
            a, b = np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), int(dense), np.int32)), pa.array(a), pa.array(b)], names=["watched", "a", "b"])

    parts = int(live.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = small.select("name", "rep", "component", "n", "sig").repartition(parts, "name").sortWithinPartitions("name", "rep")
    found = written(dealt.mapInArrow(task, "watched int, a long, b long").distinct(), "open-pairs")
    known = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = found.where("watched = 0").select("a", "b").join(known, ["a", "b"], "left_anti")
    large = rows.where((F.col("size") > NODE) & (F.col("rep") != F.col("least"))).select(F.col("least").alias("a"), F.col("rep").alias("b"))
    return pairs, written(components(found.where("watched = 1").select("a", "b").union(large)), "families")


def compared(families: DataFrame, joined: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links at the threshold between unlike components ``joined`` (v, component) of each family (v, component).

    A family's largest component is dealt into blocks of its own, which meet the other members' blocks but not each other.
    """

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for t in runs(it, 3):
            rep, side, joint = (t.column(c).to_numpy() for c in ("rep", "side", "joint"))
            if joint.min() == joint.max():
                continue
            own = [np.frombuffer(w, "<u8") for w in t.column("words").to_pylist()]
            n = np.array([len(w) for w in own])
            common = intersections(own)
            linked = (100 * common >= percent * (n[:, None] + n[None, :] - common)) & (joint[:, None] != joint[None, :])
            if t.column("i")[0].as_py() != t.column("j")[0].as_py():
                linked &= side[:, None] != side[None, :]
            left = np.ones(len(rep), bool)
            for x in np.flatnonzero(linked.any(axis=1)):
                if left[x]:
                    left[x], front = False, [x]
                    while front:
                        k = front.pop()
                        near = np.flatnonzero(linked[k] & left)
                        left[near] = False
                        front += near.tolist()
                        out += [(int(rep[k]), int(rep[y])) for y in near]
            if len(out) > 20_000:
                yield edges(out)
                out = []
        yield edges(out)

    spark = families.sparkSession
    member = families.select(F.col("v").alias("rep"), F.col("component").alias("family"))
    member = member.join(joined.select(F.col("v").alias("rep"), F.col("component").alias("joint")), "rep", "left")
    member = member.join(sets.select("rep", (F.octet_length("words") / 8).cast("long").alias("n")), "rep").select("rep", "family", F.coalesce("joint", "rep").alias("joint"), "n")
    member = written(member, "members")
    counts = member.groupBy("family", "joint").agg(F.count("*").alias("sets"), F.sum("n").alias("words"))
    blocks = lambda sets_, words: F.greatest(F.ceil(sets_ / BLOCK), F.ceil(words / BLOCK_SHINGLES), F.lit(0)).cast("int")
    largest = F.max(F.struct("sets", "words", "joint"))
    sizes = counts.groupBy("family").agg(largest.alias("main"), F.sum("sets").alias("sets"), F.sum("words").alias("words"))
    sizes = sizes.select("family", F.col("main.joint").alias("main"), blocks(F.col("main.sets"), F.col("main.words")).alias("own"),
                         blocks(F.col("sets") - F.col("main.sets"), F.col("words") - F.col("main.words")).alias("others"))
    sizes = written(sizes.where("others > 0"), "family-sizes")
    dealt = member.join(sizes, "family").join(sets, "rep")
    main = F.col("joint") == F.col("main")
    side = F.when(main, F.pmod(F.xxhash64("rep"), "own")).otherwise(F.col("own") + F.pmod(F.xxhash64("rep"), "others")).cast("int")
    other = F.explode(F.sequence(F.when(main, F.col("own")).otherwise(F.lit(0)), F.col("own") + F.col("others") - 1))
    dealt = dealt.withColumn("side", side).withColumn("other", other)
    dealt = dealt.select("family", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "rep", "joint", "words")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a family's pairs of blocks lie in a row, so that they meet in one task only where there are more of them than tasks
    place = ((F.pmod(F.xxhash64("family"), F.lit(parts)) + F.expr("j * (j + 1) div 2") + F.col("i")) % parts).cast("int")
    dealt = dealt.repartitionById(parts, place).sortWithinPartitions("family", "i", "j", "rep")
    return written(dealt.mapInArrow(task, "a long, b long"), "compared")


def intersections(sets: list[np.ndarray], wide: int = 1 << 12) -> np.ndarray:
    """Sizes of all intersections of two of the sets: products of bit matrices, some of the shared words at a time."""
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, word, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    use = times[word] > 1
    number = np.cumsum(times > 1) - 1
    who, word = who[use], number[word[use]]
    order = np.argsort(word, kind="stable")
    who, word = who[order], word[order]
    total = np.zeros((len(sets), len(sets)), np.float64)
    for k in range(0, int(word[-1]) + 1 if len(word) else 0, wide):
        a, b = np.searchsorted(word, [k, k + wide])
        bits = np.zeros((len(sets), wide), np.float32)
        bits[who[a:b], word[a:b] - k] = 1
        total += bits @ bits.T
    return total.astype(np.int64)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are at the threshold on their full sets (rep, words).

    Each pair's b goes to its a, dealt into blocks where a has many; one set and a batch of others are held at a time.
    """

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = None, np.empty(0, "<u8")
        for batch in it:
            out = []
            cols = (batch.column(c).to_pylist() for c in ("a", "block", "first", "rep", "words"))
            for a, block, first, rep, words in zip(*cols, strict=True):
                w = np.frombuffer(words, "<u8")
                if first == 0:
                    known, own = (a, block), w
                elif known != (a, block):
                    raise ValueError(f"no set of {a}")
                else:
                    at = np.searchsorted(own, w)
                    at[at == len(own)] = 0
                    common = int((own[at] == w).sum())
                    if 100 * common >= percent * (len(own) + len(w) - common):
                        out.append((a, rep))
            yield edges(out)

    spark = pairs.sparkSession
    degree = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR_BLOCK).cast("int").alias("blocks"))
    right = pairs.join(degree, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("first"), F.col("b").alias("rep"))
    left = degree.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(0).alias("first"), F.col("a").alias("rep"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.union(right).join(sets, "rep").repartition(parts, "a", "block").sortWithinPartitions("a", "block", "first", "rep")
    return written(dealt.select("a", "block", "first", "rep", "words").mapInArrow(task, "a long, b long"), "confirmed")


def full_sets(docs: DataFrame) -> DataFrame:
    """(rep, words): each text's distinct shingles."""

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for part in by_size(batch, most=PART):
                words = [s.astype("<u8").tobytes() for s in shingle_sets(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(words, pa.binary())], names=["rep", "words"])

    return docs.select("rep", "text").mapInArrow(task, "rep long, words binary")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Documents are linked when 100 * |intersection| >= percent * |union| of their sets of distinct five-word shingles
    (A-Z lower-cased; the whole sequence where there are fewer words); component_id is the smallest doc_id reachable.
    Texts that are null, empty or without words are linked with nothing.  A row without doc_id is linked with nothing:
    component_id null, kept true.  Rows of one doc_id are one document, linked as any of their texts is; n_shingles is
    each row's own.  Long texts are compared whole.  An empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    texts, similarity = narrowed(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text")), percent / 100
    facts = written(signatures(texts), "signatures")
    worded = facts.where("n > 0 AND doc_id IS NOT NULL")
    reps = worded.groupBy("f1", "f2", "n").agg(F.min(F.struct("doc_id", "text_key")).alias("one"), F.min("sig").alias("sig"))
    reps = written(reps.select(F.monotonically_increasing_id().alias("rep"), "f1", "f2", "n", F.col("one.doc_id").alias("least"), "one.text_key", "sig"), "representatives")
    named = facts.select("doc_id", "n", "f1", "f2").join(reps.select("f1", "f2", "n", "rep"), ["f1", "f2", "n"], "left")
    named = written(named.select("doc_id", "n", "rep"), "named")

    stars, groups, live = candidates(reps.select("rep", "n", "sig"), similarity)
    wanted = stars.select(F.col("a").alias("rep")).union(stars.select("b")).union(groups.select("rep")).distinct()
    wanted = written(wanted.join(reps.select("rep", F.col("least").alias("doc_id"), "text_key"), "rep"), "wanted")
    if wanted.count() <= BROADCAST_ROWS:
        sets = texts.join(F.broadcast(wanted), ["text_key", "doc_id"])
    else:
        sets = texts.join(wanted, ["text_key", "doc_id"])
    sets = written(full_sets(sets.select("rep", "text")).dropDuplicates(["rep"]), "sets")
    joined = written(components(confirmed(stars, sets, percent)), "joined")
    rest, families = other_pairs(groups, joined, live, stars, similarity)
    links = joined.select(F.col("v").alias("a"), F.col("component").alias("b"))
    links = links.union(confirmed(written(rest, "other-pairs"), sets, percent)).union(compared(families, joined, sets, percent))

    # rows of one doc_id with unlike texts are one document: their sets are linked
    several = named.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"), F.min("n").alias("fewest"))
    several = written(several.where("a <> b OR (fewest = 0 AND a IS NOT NULL)").select("doc_id", "a"), "several-texts")
    links = links.union(named.where("n > 0").select("doc_id", "rep").join(several, "doc_id").select("a", F.col("rep").alias("b")))

    least = reps.select("rep", "least")
    linked = written(components(links).withColumnRenamed("v", "rep").join(least, "rep"), "linked")
    rooted = linked.join(linked.groupBy("component").agg(F.min("least").alias("root")), "component").select("rep", "root")
    roots = written(least.join(rooted, "rep", "left").select("rep", F.coalesce("root", "least").alias("root")), "roots")
    wordless = named.where("n = 0").drop("rep").join(several, "doc_id", "left").withColumnRenamed("a", "rep")
    names = ("doc_id", "n", "rep")
    out = named.where("n > 0").select(*names).union(wordless.select(*names)).join(roots, "rep", "left")
    found = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("root", "doc_id")).cast("long")
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"),
        (F.col("doc_id").isNull() | found.eqNullSafe(F.col("doc_id"))).alias("kept"),
    )


def op2_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS sh FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v),
m AS (SELECT v, min(c) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN m ON m.v = d.doc_id
"""
