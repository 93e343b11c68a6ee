"""SentencePiece encoding and decoding with seeded merge-dropout.

The agenda of a BPE model takes the best-scored merge of two neighbouring pieces, the leftmost of equals, until none is
left.  Here a merge that comes up is skipped - for good, unless a neighbour changes - when a hash keyed by the seed, the
doc_id, the word's place in the text, the place in the word and the merge is below the dropout rate.  Every segmentation
is made of the model's merges and decodes to its text.  Each time a word stands in a text its merges are drawn anew.  A
worker remembers what the model alone decides: which merges come up next in a word after given ones were skipped.  What
isn't known yet is run for all words of a batch side by side, as rows of a matrix; long words run alone, with a heap.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.llm.common import narrowed, small_batches, table
from motionframe.llm.shingles import U, mix

DROPOUT = 0.1
SEED = 2024
WIDTHS = (8, 16, 32)
NODES = 200_000
EDGE = 64  # more than the merges of a word of WIDTHS[-1] letters
SPACE = "▁"
RUNS = re.compile(" *[^ ]+| +")
DEAD, UNKNOWN = -2, -1
MASK = (1 << 64) - 1
NO_ID = 0x632BE59BD9B4E019


class Model:
    def __init__(self, name: str):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
        self.size = sp.get_piece_size()
        plain = {sp.id_to_piece(i): i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # a space is the model's letter for it; that letter in a text is spelt in bytes, so that it comes back
        self.letter = {" " if p == SPACE else p: i for p, i in plain.items() if len(p) == 1}
        self.letter_of = np.full(0x110000, UNKNOWN, np.int32)
        self.letter_of[[ord(c) for c in self.letter]] = list(self.letter.values())
        pairs = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                if p[:k] in plain and p[k:] in plain:
                    pairs[plain[p[:k]] * self.size + plain[p[k:]]] = i
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.made = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.cost = np.array([-sp.get_score(i) for i in range(self.size)])
        self.text = [b""] * self.size
        for p, i in plain.items():
            self.text[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte):
            self.text[i] = bytes([b])
        # words are apart if no piece goes on behind a letter with a space, and no piece has a line feed
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in plain)

    def merged(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, cost) that each pair makes; cost is infinite where it makes none."""
        key = np.where((left < 0) | (right < 0), -1, left * self.size + right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        piece = self.made[at]
        return piece, np.where(self.keys[at] == key, self.cost[piece], np.inf)

    def unknown(self, letter: str) -> list[int]:
        return [self.byte[b] for b in letter.encode()]

    def letters(self, word: str) -> list[int]:
        return [self.letter.get(c, UNKNOWN) for c in word]


@cache
def model(name: str) -> Model:
    return Model(name)


def mixed(x: int) -> int:
    """shingles.mix of one number."""
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & MASK
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & MASK
    return x ^ x >> 32


def doc_key(seed: int, doc_id: int | None, text: str = "") -> int:
    """What a text's draws start from; one without doc_id has its own bytes for that."""
    own = (doc_id & MASK) if doc_id is not None else zlib.crc32(text.encode()) ^ NO_ID
    return mixed(mixed(seed * 0x9E3779B97F4A7C15 & MASK) ^ own)


def word_keys(docs: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A key for each word, by its text's key and its place in the text."""
    return mix(docs + places.astype(U) * U(0xD1B54A32D192ED03))


def part_of_hash(place: np.ndarray, merge: np.ndarray) -> np.ndarray:
    """What a merge (left * size + right) at this place in a word adds to the hash that draws it."""
    return mix(place.astype(U) << U(40) ^ merge.astype(U))


def skipped(key: np.ndarray, what: np.ndarray, rate: float) -> np.ndarray:
    """Whether the word with this key skips the merge with this part of the hash."""
    return mix(key + what) >> U(11) < U(int(rate * 2**53))


def one_word(m: Model, word: str, seed: int, doc_id: int | None, rate: float, place: int = 0) -> list[int]:
    """The agenda as a heap, for a word of any length."""
    return _on_heap(m, word, int(word_keys(np.array([doc_key(seed, doc_id)], U), np.array([place]))[0]), rate)


def _on_heap(m: Model, word: str, key: int, rate: float) -> list[int]:
    ids, n = m.letters(word), len(word)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    most = int(rate * 2**53)
    agenda: list[tuple] = []

    def propose(i: int) -> None:
        j = after[i] if i >= 0 else n
        if j < n and ids[i] >= 0 and ids[j] >= 0 and (p := m.pairs.get(ids[i] * m.size + ids[j])) is not None:
            heapq.heappush(agenda, (m.cost[p], i, p, ids[i], ids[j], j))

    for i in range(n - 1):
        propose(i)
    while agenda:
        _, i, p, left, right, j = heapq.heappop(agenda)
        if ids[i] != left or after[i] != j or ids[j] != right:
            continue
        if rate and mixed(key + mixed(i << 40 ^ left * m.size + right) & MASK) >> 11 < most:
            continue
        ids[i], ids[j], after[i] = p, DEAD, after[j]
        if after[j] < n:
            before[after[j]] = i
        propose(before[i])
        propose(i)
    return [x for i, c in zip(ids, word, strict=True) if i != DEAD for x in ([i] if i >= 0 else m.unknown(c))]


def many_words(m: Model, words: list[str], seed: int, doc_id: int | None, rate: float, place: int = 0) -> list[bytes]:
    """ids (little-endian uint32) of words of WIDTHS[-1] letters at most, agendas in step."""
    own = Agendas(m)
    keys = word_keys(np.full(len(words), doc_key(seed, doc_id), U), np.full(len(words), place))
    return own.segmented(words, keys, rate)


class Agendas:
    """What the model alone decides, remembered: a word's agenda for each sequence of skips that was drawn so far.

    A node is a word with the steps of its agenda that are skipped.  It has the merges that come up after the last of
    these if no more are skipped, and the ids that this leads to.  Draws aren't kept: each time a word stands in a text it goes
    down from the word's first node, at each node to the child of the first merge that its own key skips.
    """

    def __init__(self, m: Model):
        self.m = m
        self.forget()

    def forget(self) -> None:
        self.root: dict[str, int] = {}
        self.child: dict[int, int] = {}
        self.word: list[str] = []
        self.skips: list[tuple[int, ...]] = []
        self.ids: list[bytes] = []
        self.what = np.empty(0, U)  # of each merge, its part of the hash that draws it
        self.begin = np.zeros(1, np.int64)

    def grow(self, words: list[str], skips: list[tuple[int, ...]]) -> np.ndarray:
        """Numbers of new nodes, one for each word and steps to skip."""
        first = len(self.word)
        self.word += words
        self.skips += skips
        ids, counts, whats = _in_widths(self.m, words, skips)
        self.ids += ids
        self.what = np.concatenate([self.what, whats])
        self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(counts)])
        return np.arange(first, len(self.word))

    def segmented(self, words: list[str], keys: np.ndarray, rate: float) -> list[bytes]:
        """ids of each word under its key.

        Words and skips that come up once here and aren't known run by their keys alone; they may not come again.  A word
        of more than WIDTHS[-1] letters runs alone, with a heap.
        """
        if len(self.word) > NODES:
            self.forget()
        coded = pa.array(words, pa.string()).dictionary_encode()
        which, unlike = np.asarray(coded.indices), coded.dictionary.to_pylist()
        often = np.bincount(which, minlength=len(unlike)) > 1
        lens = np.fromiter(map(len, unlike), np.int64, len(unlike))
        first = np.fromiter(map(self.root.get, unlike, repeat(-1)), np.int64, len(unlike))
        new = np.flatnonzero((first < 0) & often & (lens <= WIDTHS[-1]))
        if len(new):
            first[new] = self.grow(own := [unlike[i] for i in new.tolist()], [()] * len(own))
            self.root.update(zip(own, first[new].tolist(), strict=True))
        node = first[which]
        alone, on = [np.flatnonzero((node < 0) & (lens[which] <= WIDTHS[-1]))], np.flatnonzero(node >= 0)
        while rate and len(on):
            on, step = self.first_skips(node, on, keys, rate)
            found, at, times = np.unique(node[on] * EDGE + step, return_inverse=True, return_counts=True)
            child = np.fromiter(map(self.child.get, found.tolist(), repeat(-1)), np.int64, len(found))
            lack = np.flatnonzero((child < 0) & (times > 1))
            if len(lack):
                parent, skip = (x.tolist() for x in np.divmod(found[lack], EDGE))
                last = [(self.skips[p][-1] + 1 if self.skips[p] else 0) for p in parent]
                child[lack] = self.grow([self.word[p] for p in parent], [(*self.skips[p], n + k) for p, n, k in zip(parent, last, skip, strict=True)])
                self.child.update(zip(found[lack].tolist(), child[lack].tolist(), strict=True))
            node[on] = child[at]
            alone.append(on[child[at] < 0])
            on = on[child[at] >= 0]
        ids = self.ids
        out = [ids[i] if i >= 0 else b"" for i in node.tolist()]
        once = np.concatenate(alone)
        for i, b in zip(once.tolist(), _in_widths(self.m, [words[i] for i in once.tolist()], None, keys[once], rate)[0], strict=True):
            out[i] = b
        for i in np.flatnonzero(lens[which] > WIDTHS[-1]).tolist():
            out[i] = array("I", _on_heap(self.m, words[i], int(keys[i]), rate)).tobytes()
        return out

    def first_skips(self, node: np.ndarray, on: np.ndarray, keys: np.ndarray, rate: float, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words ``on`` skip a merge of their node, and the first one's place among the node's merges."""
        who, steps = [], []
        for s in range(0, len(on), most):
            own = on[s : s + most]
            begin = self.begin[node[own]]
            n = self.begin[node[own] + 1] - begin
            start = np.cumsum(n) - n
            row = np.repeat(np.arange(len(own)), n)
            within = np.arange(len(row)) - start[row]
            gone = np.flatnonzero(skipped(keys[own][row], self.what[begin[row] + within], rate))
            hit = row[gone]
            first = np.flatnonzero(np.concatenate([[True], hit[1:] != hit[:-1]])) if len(hit) else gone
            who.append(own[hit[first]])
            steps.append(within[gone[first]])
        return np.concatenate(who), np.concatenate(steps)


def _in_widths(m: Model, words: list[str], skips: list[tuple[int, ...]] | None, keys: np.ndarray | None = None, rate: float = 0.0) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """ids of each word with these steps of its agenda skipped; how many merges come up after the last of them; those in order.

    Where skips is None, each word's key tells what it skips, and merges aren't noted.
    """
    out: list[bytes] = [b""] * len(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    made: list[tuple[np.ndarray, np.ndarray]] = []
    for low, wide in zip((0, *WIDTHS), WIDTHS, strict=False):
        own = np.flatnonzero((low < lens) & (lens <= wide)).tolist()
        for s in range(0, len(own), 8192):
            part = own[s : s + 8192]
            ids, merges = _in_step(m, [words[i] for i in part], wide, skips and [skips[i] for i in part], None if keys is None else keys[part], rate)
            for i, b in zip(part, ids, strict=True):
                out[i] = b
            made += [(np.array(part)[row], what) for row, what in merges]
    if not made:
        return out, np.zeros(len(words), np.int64), np.empty(0, U)
    row, what = (np.concatenate(c) for c in zip(*made, strict=True))
    return out, np.bincount(row, minlength=len(words)), what[np.argsort(row, kind="stable")]


def _in_step(m: Model, words: list[str], wide: int, skips: list[tuple[int, ...]] | None, key: np.ndarray | None, rate: float) -> tuple[list[bytes], list[tuple[np.ndarray, np.ndarray]]]:
    """ids, and (row, what) of the merges that come up after each word's last skip, for words of ``wide`` letters at most."""
    n = len(words)
    lens = np.array([len(w) for w in words])
    ids = np.full((n, wide + 1), DEAD, np.int64)
    ids[np.arange(wide + 1) < lens[:, None]] = m.letter_of[np.frombuffer("".join(words).encode("utf-32-le"), "<u4")]
    after = np.tile(np.arange(1, wide + 2), (n, 1))
    before = np.tile(np.arange(-1, wide), (n, 1))
    piece, cost = m.merged(ids[:, :-1].ravel(), ids[:, 1:].ravel())
    piece, cost = piece.reshape(n, wide), cost.reshape(n, wide)
    skip_at: dict[int, list[int]] = {}
    for i, steps in enumerate(skips or []):
        for t in steps:
            skip_at.setdefault(t, []).append(i)
    free = np.array([steps[-1] + 1 if steps else 0 for steps in skips]) if skips else None
    live, step, merges = np.arange(n), 0, []
    while len(live):  # each word that is live takes its next merge
        at = cost[live].argmin(axis=1)
        on = np.isfinite(cost[live, at])
        live, at = live[on], at[on]
        if not len(live):
            break
        made = piece[live, at]
        cost[live, at] = np.inf
        if free is None:
            go = ~skipped(key[live], part_of_hash(at, ids[live, at] * m.size + ids[live, after[live, at]]), rate)
        else:
            seen = free[live] <= step
            r, a = live[seen], at[seen]
            merges.append((r, part_of_hash(a, ids[r, a] * m.size + ids[r, after[r, a]])))
            go = np.ones(n, bool)
            go[skip_at.get(step, [])] = False
            go = go[live]
        step += 1
        r, a, p = live[go], at[go], made[go]
        j = after[r, a]
        ids[r, a], ids[r, j], cost[r, np.minimum(j, wide - 1)] = p, DEAD, np.inf
        k = after[r, j]
        after[r, a] = k
        inside = k < lens[r]
        before[r[inside], k[inside]] = a[inside]
        piece[r[inside], a[inside]], cost[r[inside], a[inside]] = m.merged(p[inside], ids[r[inside], k[inside]])
        b = before[r, a]
        has = b >= 0
        piece[r[has], b[has]], cost[r[has], b[has]] = m.merged(ids[r[has], b[has]], p[has])
    flat = ids[ids != DEAD]
    ends = np.cumsum((ids != DEAD).sum(axis=1))
    odd = np.flatnonzero((ids == UNKNOWN).any(axis=1))
    data = flat.astype("<u4").tobytes()
    out = [data[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    for i in odd:
        out[i] = array("I", [x for c, w in zip(ids[i], words[i], strict=False) if c != DEAD for x in ([int(c)] if c >= 0 else m.unknown(w))]).tobytes()
    return out, merges


@cache
def agendas(name: str) -> Agendas:
    """One for each worker process."""
    return Agendas(model(name))


class Encoder:
    def __init__(self, name: str, seed: int, rate: float):
        self.m, self.seed, self.rate, self.agendas = model(name), seed, rate, agendas(name)

    def words(self, text: str) -> list[str]:
        """The text behind the space that every text gets, cut before each run of spaces and around each line feed."""
        if not self.m.apart:
            return [" " + text]
        out: list[str] = []
        for line in (" " + text).split("\n"):
            if "  " in line or line[-1:] == " ":
                out += RUNS.findall(line)
            elif line:
                first, *more = line.split(" ")
                if first:
                    out.append(first)
                out += map(" ".__add__, more)
            out.append("\n")
        out.pop()
        return out

    def encode(self, doc_ids: list[int | None], texts: list[str]) -> list[bytes]:
        """ids of each text, little-endian uint32; an empty text has none."""
        cut = [self.words(t) if t else [] for t in texts]
        counts = np.array([len(ws) for ws in cut], np.int64)
        flat = [w for ws in cut for w in ws]
        ends = np.cumsum(counts)
        docs = np.array([doc_key(self.seed, d, t) for d, t in zip(doc_ids, texts, strict=True)], U)
        keys = word_keys(np.repeat(docs, counts), np.arange(len(flat)) - np.repeat(ends - counts, counts))
        out = self.agendas.segmented(flat, keys, self.rate)
        return [b"".join(out[e - n : e]) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def decoded(m: Model, ids: np.ndarray) -> str:
    """The text that the ids spell; ids that spell no UTF-8 are an error."""
    return b"".join(map(m.text.__getitem__, ids.tolist()))[1:].decode("utf-8")


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "piece_bpe_32k.model",
    seed: int = SEED, dropout: float = DROPOUT,
) -> DataFrame:
    """doc_id, ids (binary, little-endian uint32), n_ids, source_sha256 (of the text): one row per input row.

    A null or empty text has no ids.  dropout 0 gives the model's own segmentation.  The same seed, doc_id and text give
    the same ids, on any partitioning; rows that repeat are encoded alike, and a row without doc_id draws by its text.  A
    long text is encoded whole; a word of more than 32 letters takes time with the logarithm of its length for each.
    An empty table gives an empty result; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Encoder(name, seed, dropout)
        for b in it:
            ids = own.encode(b.column(0).to_pylist(), b.column(1).to_pylist())
            cols = [b.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), b.column(2)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "ids", "n_ids", "source_sha256"])

    rows = narrowed(docs, id_col, text_col)
    return rows.withColumn("source_sha256", F.sha2("text", 256)).mapInArrow(task, "doc_id long, ids binary, n_ids long, source_sha256 string")


def decode(rows: DataFrame, name: str = "piece_bpe_32k.model", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_ids, ids_crc32, text, and the columns ``carry``, of rows (doc_id, ids): the text that the ids spell.

    No ids, or null, spell an empty text.
    """

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(name)
        for b in it:
            ids = [np.frombuffer(x or b"", "<u4") for x in b.column("ids").to_pylist()]
            cols = [b.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([decoded(m, x) for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *(b.column(c) for c in carry)], names=["doc_id", "n_ids", "ids_crc32", "text", *carry])

    kinds = "".join(f", {c} {t}" for c, t in rows.select(*carry).dtypes) if carry else ""
    return rows.select("doc_id", "ids", *carry).mapInArrow(task, f"doc_id long, n_ids long, ids_crc32 long, text string{kinds}")


def op9_merge_dropout(spark, sf_dir: str) -> DataFrame:
    """Each whole text encoded and decoded: the number and crc32 of its ids, the digest of the text that they spell, and
    whether that is the text they came from."""
    out = decode(encode(table(spark, sf_dir, "documents")), carry=("source_sha256",))
    spelt = F.sha2("text", 256)
    return out.select("doc_id", "n_ids", "ids_crc32", spelt.alias("text_sha256"), (spelt == F.col("source_sha256")).alias("lossless"))
