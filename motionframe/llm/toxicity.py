"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer turns words into symbols: insults (stems learnt from labels, each with a weight), threats, targets,
negations, words of reporting, and marks that end a clause.  Three sequential transducers, tables of (next state, output),
mark the insults and threats that they find: one those within ``REACH`` symbols of a target, one those that follow a
negation as closely, one those behind a word of reporting in the clause.  They are composed into one table.  A clause is
read by the first of them from right to left, so that targets ahead count as well, and by the composition from left to
right.  Each insult or threat that comes out has a kind - plain, aimed, negated, reported, threat - and each kind a
weight that is learnt, so what an insult counts depends on the clause that it stands in.  A document's score is a logistic
function of its matched clauses' scores by kind, of the highest of them, and of the share of clauses that match.

What is learnt - the stems with their weights, and the logistic function - comes from at most ``MOST_TOXIC`` toxic and
``MOST_CLEAN`` other labelled documents of ``MOST_BYTES`` in all, taken in order of a hash of their id.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionframe.llm.common import narrowed, small_batches, table, written

MOST_TOXIC = 1500
MOST_CLEAN = 5000
MOST_BYTES = 64_000_000
STEMS = 120
SHORTEST, LONGEST = 4, 9
#: Closed word lists of the grammar, in English, German, French and Spanish.
TARGETS = frozenset(
    "you your yours yourself u ur they them she him her he these those du dich dir dein deine ihr euch euer sie er ihn "
    "tu toi te ton ta tes vous votre vos il elle ils elles tú ti usted ustedes vosotros él ella ellos ellas".split()
)
THREATS = frozenset(
    "kill hurt destroy beat burn shoot stab punch strangle murder töten umbringen schlagen verbrennen erschießen zerstören "
    "tuer frapper brûler détruire assassiner poignarder matar golpear quemar destruir apuñalar disparar".split()
)
NEGATIONS = frozenset(
    "not never no isn't aren't don't wasn't nobody none without nicht nie niemals kein keine keiner ohne "
    "pas jamais aucun aucune sans ni nunca jamás ningún ninguna sin".split()
)
REPORTS = frozenset(
    "said says say told wrote writes quoted called claimed according sagte sagt schrieb meinte behauptete laut "
    "dit écrit raconte affirme selon dijo dice escribió afirmó según".split()
)
#: Symbols.  An insult or threat has its marks as bits on top.
OTHER, TARGET, NEGATION, REPORT, THREAT, INSULT = range(6)
HITS = (THREAT, INSULT)
AIMED, NEGATED, REPORTED = 8, 16, 32
SYMBOLS = 64
REACH = 6
SHORT = 8  # words that a clause has at least, on average
KINDS = ("plain", "aimed", "negated", "reported", "threat")
#: How the lexical transducer writes them: a byte a word, then a line feed where a clause ends; insults have a byte a stem.
END = 0x0A
BYTES = {OTHER: 5, TARGET: 1, NEGATION: 3, REPORT: 4, THREAT: 2}
FIRST_STEM = 0x80
EDGE = re.compile(r"^\W+|\W+$")
ENDS = frozenset(".!?;:|")
HIT = re.compile(rb"[\x02\x80-\xff]")
SYMBOL_OF = bytes(INSULT if b >= FIRST_STEM else next((k for k, v in BYTES.items() if v == b), OTHER) for b in range(256))


@dataclass(frozen=True)
class Transducer:
    """A sequential transducer: in state q the symbol x leads to state step[q][x] and writes out[q][x]; it begins in state 0."""

    step: list[list[int]]
    out: list[list[int]]

    def run(self, symbols: bytes) -> bytearray:
        q, written_, step, out = 0, bytearray(len(symbols)), self.step, self.out
        for i, x in enumerate(symbols):
            written_[i] = out[q][x]
            q = step[q][x]
        return written_


def marking(states: int, enters: Callable[[int, int], int], marked: Callable[[int], bool], mark: int) -> Transducer:
    """States whose hits get a mark on top: enters(state, plain symbol) is the next state."""
    is_hit = lambda x: x % 8 in HITS
    step = [[enters(q, x % 8) for x in range(SYMBOLS)] for q in range(states)]
    return Transducer(step, [[x | mark if is_hit(x) and marked(q) else x for x in range(SYMBOLS)] for q in range(states)])


def near(symbol: int, mark: int, reach: int = REACH) -> Transducer:
    """Marks hits at most ``reach`` symbols behind the last ``symbol``: the state counts down from there."""
    return marking(reach + 1, lambda q, x: reach if x == symbol else max(0, q - 1), lambda q: q > 0, mark)


def since(symbol: int, mark: int) -> Transducer:
    """Marks all hits behind a ``symbol``."""
    return marking(2, lambda q, x: 1 if x == symbol else q, lambda q: q == 1, mark)


def composed(a: Transducer, b: Transducer) -> Transducer:
    """What b makes of a's output, as one transducer: its states are the pairs of states that can be reached."""
    pairs, number, step, out = [(0, 0)], {(0, 0): 0}, [], []
    for p, q in pairs:
        to, wrote = [], []
        for x in range(SYMBOLS):
            y = a.out[p][x]
            pair = a.step[p][x], b.step[q][y]
            if pair not in number:
                number[pair] = len(pairs)
                pairs.append(pair)
            to.append(number[pair])
            wrote.append(b.out[q][y])
        step.append(to)
        out.append(wrote)
    return Transducer(step, out)


@cache
def grammar() -> tuple[Transducer, Transducer]:
    """(read from right to left, read from left to right)."""
    aimed = near(TARGET, AIMED)
    return aimed, composed(composed(aimed, near(NEGATION, NEGATED)), since(REPORT, REPORTED))


def kind_of(symbol: int) -> str | None:
    """The kind of a marked insult or threat; a threat counts only at somebody, and any other symbol is none."""
    if symbol % 8 not in HITS or (symbol % 8 == THREAT and not symbol & AIMED):
        return None
    if symbol & REPORTED:
        return "reported"
    if symbol & NEGATED:
        return "negated"
    return "threat" if symbol % 8 == THREAT else "aimed" if symbol & AIMED else "plain"


KIND_OF = [kind_of(x) for x in range(SYMBOLS)]


@dataclass(frozen=True)
class Model:
    stems: dict[str, tuple[int, float]]  # stem ("*" at its end: any word that goes on) to its byte and weight
    weights: tuple[float, ...]


class Lexicon(dict):
    """Word as it stands in a text to its byte, and END after it where it ends a clause; remembers words met."""

    def __init__(self, stems: dict[str, tuple[int, float]], most: int = 100_000):
        self.stems, self.most = stems, most
        self.forms: dict[bytes, bytes] = {}  # what words become: few values, each held once
        self.listed = {w: k for k, words in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (THREAT, THREATS), (TARGET, TARGETS)) for w in words}

    def __missing__(self, word: str) -> bytes:
        bare = EDGE.sub("", word).lower()
        # a mark that stands alone, as between the cells of a row, ends no clause
        found = bytes([self.byte(bare)]) + (b"\n" if bare and word[-1:] in ENDS else b"")
        found = self.forms.setdefault(found, found)
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found

    def byte(self, bare: str) -> int:
        if bare in self.stems:
            return self.stems[bare][0]
        for k in range(min(len(bare) - 1, LONGEST), SHORTEST - 2, -1):
            if (stem := bare[:k] + "*") in self.stems:
                return self.stems[stem][0]
        return BYTES[self.listed.get(bare, OTHER)]


def matches(clause: bytes, weight: dict[int, float]) -> Iterator[tuple[int, str, float]]:
    """(place, kind, lexical weight) of each insult or threat of a clause, as the grammar reads it; linear time."""
    backward, forward = grammar()
    symbols = backward.run(clause.translate(SYMBOL_OF)[::-1])[::-1]
    for i, x in enumerate(forward.run(symbols)):
        if (kind := KIND_OF[x]) is not None:
            yield i, kind, weight.get(clause[i], 1.0)


N_FEATURES = 4 + 2 * len(KINDS)


def judged(text: str, lexicon: Lexicon, weight: dict[int, float]) -> tuple[np.ndarray, list[tuple[int, str, float]]]:
    """Features of a text's matched clauses, and the matches as (word's place in the text, kind, weight)."""
    words = text.split()
    symbols = b"".join(map(lexicon.__getitem__, words))
    found: list[tuple[int, str, float]] = []
    total, best, clauses = dict.fromkeys(KINDS, 0.0), dict.fromkeys(KINDS, 0.0), 0
    at = 0
    if HIT.search(symbols):
        for clause in symbols.split(b"\n"):
            if HIT.search(clause):
                own = dict.fromkeys(KINDS, 0.0)
                for i, kind, w in matches(clause, weight):
                    own[kind] += w
                    found.append((at + i, kind, w))
                clauses += any(own.values())
                for k, v in own.items():
                    total[k] += v
                    best[k] = max(best[k], v)
            at += len(clause)
    n = min(symbols.count(b"\n"), len(words) // SHORT) + 1  # a text whose every word ends a clause has fewer than it seems
    own = [math.log1p(total[k]) for k in KINDS] + [best[k] for k in KINDS]
    return np.array([1.0, math.log1p(clauses), 10 * clauses / (n + 10), float(clauses > 1), *own]), found


def parts(text: str) -> set[str]:
    """Words of a text, and their beginnings with an asterisk."""
    found = set()
    for word in set(text.lower().split()):
        bare = EDGE.sub("", word)
        if len(bare) >= 3:
            found.add(bare)
            found.update(bare[:k] + "*" for k in range(SHORTEST, min(len(bare), LONGEST + 1)))
    return found


def learn_stems(toxic: list[str], clean: list[str], most: int = STEMS) -> dict[str, tuple[int, float]]:
    """The stems whose presence speaks most for the label, each with its log odds; a longer one only if it adds some."""
    pos: Counter = Counter()
    for t in toxic:
        pos.update(parts(t))
    least = max(3, 0.012 * len(toxic))
    pos = Counter({k: v for k, v in pos.items() if v >= least})
    neg: Counter = Counter()
    known: dict[str, tuple[str, ...]] = {}  # a word's parts that are in pos, mostly none

    def in_pos(word: str) -> tuple[str, ...]:
        if len(known) > 300_000:
            known.clear()
        if word not in known:
            known[word] = tuple(p for p in parts(word) if p in pos)
        return known[word]

    for t in clean:
        own: set[str] = set()
        for word in set(t.lower().split()):
            if part := known.get(word) if word in known else in_pos(word):
                own.update(part)
        neg.update(own)
    odds = {k: math.log((v + 0.5) / (len(toxic) + 1) * (len(clean) + 1) / (neg[k] + 0.5)) for k, v in pos.items()}
    chosen: dict[str, float] = {}
    for k in sorted(pos, key=lambda k: (-pos[k] * (odds[k] - 0.5), len(k), k)):
        shorter = max((chosen.get(k[:n] + "*", -9.0) for n in range(SHORTEST, len(k))), default=-9.0)
        if odds[k] >= 1.7 and odds[k] > shorter + 0.7 and len(chosen) < most:
            chosen[k] = odds[k]
    return {k: (FIRST_STEM + i, w) for i, (k, w) in enumerate(chosen.items())}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Newton's method on the ridge-penalised likelihood; steps are halved while it falls."""
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[0, 0] = 1e-6
    loss = lambda w: np.logaddexp(0, np.where(y, -1, 1) * (x @ w)).sum() + w @ penalty @ w / 2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return w


def fit(rows: list[tuple[str, int]], shares: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Stems from half of the rows and the logistic function from the other half, so that it sees stems as new text has them.

    shares: which part of all labelled documents the rows are, clean and toxic; the offset is put right for them.
    """
    if not rows:
        return Model({}, tuple(np.zeros(N_FEATURES)))
    halves = [rows[::2], rows[1::2]]
    trial = [learn_stems([t for t, y in h if y], [t for t, y in h if not y]) for h in halves]
    x, y = [], []
    for own, stems in zip(halves, reversed(trial), strict=True):
        lexicon, weight = Lexicon(stems), dict(stems.values())
        x += [judged(t, lexicon, weight)[0] for t, _ in own]
        y += [label for _, label in own]
    weights = logistic(np.array(x), np.array(y, bool))
    weights[0] += math.log(shares[0] / shares[1])
    stems = learn_stems([t for t, y in rows if y], [t for t, y in rows if not y])
    return Model(stems, tuple(weights))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[list[tuple[str, int]], tuple[float, float]]:
    """(text, label) of at most MOST_TOXIC and MOST_CLEAN labelled documents, MOST_BYTES in all, whose crc32 of the id is
    not 0 modulo 5; and which share of such labels of either kind that is, clean and toxic.

    Of rows that repeat a doc_id one speaks, the least text; a document with unlike labels is toxic.
    """
    marks = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("mark"))
    marks = marks.where(F.col("mark").isin(0, 1) & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    marks = marks.groupBy("doc_id").agg(F.max("mark").alias("mark"))
    counts = dict(tuple(r) for r in marks.groupBy("mark").count().collect())
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    few = marks.where("mark = 1").orderBy(*order).limit(MOST_TOXIC).union(marks.where("mark = 0").orderBy(*order).limit(MOST_CLEAN))
    # at most MOST_TOXIC + MOST_CLEAN pairs of numbers
    found = narrowed(docs, id_col, text_col).join(F.broadcast(few), "doc_id").groupBy("doc_id", "mark").agg(F.min("text").alias("text"))
    found = written(found, "labelled")
    sizes = sorted(tuple(r) for r in found.select(F.xxhash64("doc_id"), "doc_id", "mark", F.octet_length("text")).collect())
    taken, left = [], MOST_BYTES
    for _, doc_id, mark, size in sizes:
        if size <= left:
            left -= size
            taken.append((doc_id, mark))
    own = found.sparkSession.createDataFrame(taken, "doc_id long, mark int").select("doc_id")
    texts = {r.doc_id: r.text for r in found.join(F.broadcast(own), "doc_id").select("doc_id", "text").collect()}  # MOST_BYTES at most
    rows = [(texts[i], mark) for i, mark in sorted(taken)]
    share = [max(1, sum(mark == k for _, mark in taken)) / max(1, counts.get(k, 0)) for k in (0, 1)]
    return rows, (min(1.0, share[0]), min(1.0, share[1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    small_batches(docs.sparkSession)
    return fit(*labelled_sample(docs, labels, id_col, text_col, label_col))


FOUND = "array<struct<word:int,kind:string,weight:double>>"


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_matches, matches for each row: score from 0 to 1; matches are the insults and threats that the
    grammar found, by the word's place in the text, kind and lexical weight.

    A null text is empty; an empty text gets the score of a text without matches.  Long texts are read whole, in linear time.
    Rows that repeat and rows without doc_id are scored as they come.  Without labelled rows the score is 0.5
    throughout.  Other columns are ignored.
    """
    out = narrowed(docs, id_col, text_col).mapInArrow(scorer(model, ["doc_id"], matched=True), f"doc_id long, score double, matches {FOUND}")
    return out.select("doc_id", "score", F.size("matches").alias("n_matches"), "matches")


def scorer(model: Model, keep: list[str], name: str = "score", text_col: str = "text", matched: bool = False):
    """A mapInArrow function: columns ``keep``, then the score as ``name``, and the matches if wanted, of batches with texts."""
    w = np.array(model.weights)
    weight = dict(model.stems.values())
    kind = pa.list_(pa.struct([("word", pa.int32()), ("kind", pa.string()), ("weight", pa.float64())]))

    def task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.stems)
        for b in it:
            rows = [judged(t.as_py() or "", lexicon, weight) for t in b.column(text_col)]
            x = np.array([r[0] for r in rows]).reshape(-1, len(w))
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            cols = [*(b.column(c) for c in keep), pa.array(p, pa.float64())]
            if matched:
                cols.append(pa.array([[{"word": i, "kind": k, "weight": v} for i, k, v in r[1]] for r in rows], kind))
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, name, *(["matches"] if matched else [])])

    return task


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity(docs, train(docs, labels))
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
