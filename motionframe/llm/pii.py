"""Personal data by weak supervision, all in DataFrame functions.

Base spans - e-mail and IP addresses, payment cards, telephone numbers - are what fixed patterns and their checks say.
Beyond them, wider patterns propose candidates: quoted runs of key characters and values assigned to names of secrets
(kind ``secret``), and numbers of 13 or more digits that are no valid card (kind ``number``).
Four labelers vote on every span, base ones too (1 personal, 0 not, 2 abstains): the shape of its characters, a
gazetteer of words in the ``NEAR`` characters before it, the characters around it, and how evenly its digits are
spread.  One scan writes every row's spans with their votes and ``FLAGS`` yes-or-no features.  Spans are counted by kind,
votes and features (at most 6 x 3**4 x 2**8 rows reach the driver, whatever the data); expectation-maximisation
estimates each labeler's reliabilities without any label, and a logistic span classifier over the features is trained on
the posteriors.  A candidate that it gives 0.5 or more is added; base spans stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionframe.llm.common import narrowed, table, written

#: The base patterns, leftmost and non-overlapping.  Possessive quantifiers and the look-behinds only
#: stop retries that can't succeed, so that long runs of letters or digits take linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")
QUOTED = r"[\x22'][A-Za-z0-9+/_-]{16,}+[\x22']"
ASSIGNED = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\x20]{0,2}[=:][\x20]{0,2}[^\s\x22',;]{6,}+"
GAZETTEER = r"(?i)(?:token|key|secret|password|passwd|pwd|api|auth|account|card|konto|iban|visa|kunde|customer|member|mail|phone|tel|host)[\x20:=#\"'.-]*$"
COUNTER = r"(?i)(?:isbn|issn|page|line|version|no\.?)[\x20:.]*$"
NEAR = 24
VOTERS, FLAGS = 4, 8
THRESHOLD = 0.5
ROUNDS = 100
CHUNK = 1024
SPAN = "struct<kind:string,start:bigint,end:bigint,found:string,before:string,after:string>"
JUDGED = "struct<kind:string,start:bigint,end:bigint,base:boolean,votes:string,flags:string>"


def empty(kind: str) -> Column:
    return F.expr(f"CAST(array() AS array<{kind}>)")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What join makes of each beginning of an array of long numbers, by doubling: n log n steps."""
    bits = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int")

    def doubled(acc: Column, k: Column) -> Column:
        far = F.pow(F.lit(2), k).cast("int")
        return F.transform(acc, lambda x, i: F.when(i < far, x).otherwise(join(x, F.get(acc, i - far)))).cast("array<bigint>")

    return F.aggregate(F.sequence(F.lit(0), bits), values.cast("array<bigint>"), doubled)


def located(text: Column, pattern: str, guard: Column, kind: str) -> Column:
    """array<SPAN> of the pattern's matches, in code points, with the characters next to them; the pattern runs behind its guard."""
    rx = "r'" + pattern.replace("'", r"\x27") + "'"
    matches = F.when(guard, F.expr(f"regexp_extract_all(text, {rx}, 0)")).otherwise(F.expr("CAST(array() AS array<string>)"))

    def spans(s: Column) -> Column:
        ends = running(F.zip_with(s["m"], s["g"], lambda m, g: F.coalesce(F.length(m), F.lit(0)) + F.length(g)), lambda a, b: a + b)

        def span(m: Column, i: Column, e: Column) -> Column:
            end, next_gap = F.get(e, i), F.get(s["g"], i + 1)
            before = F.right(F.concat(F.when(i > 0, F.get(s["m"], i - 1)).otherwise(F.lit("")), F.get(s["g"], i)), F.lit(NEAR))
            after = F.when(F.length(next_gap) > 0, F.left(next_gap, F.lit(1))).otherwise(F.left(F.coalesce(F.get(s["m"], i + 1), F.lit("")), F.lit(1)))
            return F.struct(
                F.lit(kind).alias("kind"), (end - F.length(m)).alias("start"), end.alias("end"), m.alias("found"), before.alias("before"), after.alias("after")
            )

        return let(ends, lambda e: F.transform(s["m"], lambda m, i: span(m, i, e)))

    found = let(matches, lambda m: F.when(F.size(m) > 0, let(F.struct(m.alias("m"), F.split(text, pattern, -1).alias("g")), spans)))
    return F.coalesce(found, empty(SPAN)).cast(f"array<{SPAN}>")


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(c: Column) -> Column:
    """Whether the digits of c pass Luhn's check; every second from the right is doubled."""
    total = F.aggregate(
        F.split(F.reverse(digits(c)), ""),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")),
        lambda s, d: F.when(d == "", s).otherwise(
            F.struct(
                (s["sum"] + F.when(s["i"] % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.when(d.cast("int") > 4, 1).otherwise(0))).alias("sum"),
                (s["i"] + 1).alias("i"),
            )
        ),
        lambda s: s["sum"],
    )
    return total % 10 == 0


def valid_card(c: Column) -> Column:
    return F.when(F.length(digits(c)).between(13, 19), luhn(c)).otherwise(False)


def valid_ip(c: Column) -> Column:
    return F.forall(F.split(c, r"\."), lambda p: F.ltrim(p, F.lit("0")).rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def judged(s: Column, base: Column) -> Column:
    """A span with the labelers' votes and its features, from what it holds and what stands next to it."""

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, F.lit("1")).when(no, F.lit("0")).otherwise(F.lit("2"))

    found, before, after = s["found"], s["before"], s["after"]
    n, d = F.length(found), F.length(digits(found))
    secret, number = s["kind"] == "secret", s["kind"] == "number"
    unlike = F.size(F.array_distinct(F.split(digits(found), "")))
    key_like = found.rlike("^.?(?i:[0-9a-f]{32,}|(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9+/_-]{20,}).?$")
    grouped = found.rlike("^[0-9]{13,19}$") | found.rlike("^[0-9]{4}([ -][0-9]{4}){3}$")
    listed, apart = before.rlike(GAZETTEER), ~before.rlike(r"[\p{L}0-9._/-]$") & ~after.rlike(r"[\p{L}0-9_/]")
    glued = before.rlike(r"[\p{L}_]$") | after.rlike(r"[\p{L}_]")
    assigned = before.rlike(r"[=:]\x20?$")
    votes = (
        vote(base | F.when(secret, key_like).otherwise(grouped), F.when(number, d > 19).otherwise(d == 0)),
        vote(listed, before.rlike(COUNTER)),
        vote(F.when(secret, assigned).otherwise(apart), glued),
        vote((d >= 8) & (unlike >= 5), (d * 4 < n) | (unlike <= 3)),
    )
    flags = (key_like, grouped, listed, assigned, apart, n >= 20, unlike >= 5, d * 2 >= n)
    flag = lambda c: F.when(c, F.lit("1")).otherwise(F.lit("0"))
    return F.struct(s["kind"], s["start"], s["end"], base.alias("base"), F.concat(*votes).alias("votes"), F.concat(*map(flag, flags)).alias("flags"))


def proposed(docs: DataFrame) -> DataFrame:
    """docs with text, and spans: array<JUDGED> of base spans by kind and start, then of candidates."""
    text = F.col("text")
    some_digits = text.rlike("[0-9]")
    found = (
        docs.withColumn("_email", located(text, EMAIL, text.contains("@"), "email"))
        .withColumn("_ip", located(text, IP, text.rlike(r"[0-9]\.[0-9]"), "ip"))
        .withColumn("_card", located(text, CARD, some_digits, "card"))
        .withColumn("_phone", located(text, PHONE, text.contains("+"), "phone"))
        .withColumn("_quoted", located(text, QUOTED, text.contains('"') | text.contains("'"), "secret"))
        .withColumn("_assigned", located(text, ASSIGNED, text.contains("=") | text.contains(":"), "secret"))
    )
    n = lambda s: F.length(digits(s["found"]))
    yes, no = F.lit(True), F.lit(False)
    base = lambda c, good: F.transform(F.filter(F.col(c), good), lambda s: judged(s, yes))

    def number(s: Column) -> Column:
        return F.struct(F.lit("number").alias("kind"), s["start"], s["end"], s["found"], s["before"], s["after"])

    def value(s: Column) -> Column:
        own = F.regexp_extract(s["found"], r"^[^=:]*[=:]\x20{0,2}(.*)$", 1)
        name = F.left(s["found"], F.length(s["found"]) - F.length(own))
        return F.struct(s["kind"], (s["end"] - F.length(own)).alias("start"), s["end"], own.alias("found"), F.right(F.concat(s["before"], name), F.lit(NEAR)).alias("before"), s["after"])

    numbers = F.transform(F.filter("_card", lambda s: ~valid_card(s["found"])), lambda s: judged(number(s), no))
    # digits within a longer word are no number of their own
    numbers = F.filter(numbers, lambda s: F.substring(s["votes"], 3, 1) != "0")
    secrets = F.concat(F.col("_quoted"), F.transform("_assigned", value))
    spans = (
        base("_email", lambda s: yes), base("_ip", lambda s: valid_ip(s["found"])), base("_card", lambda s: valid_card(s["found"])),
        base("_phone", lambda s: n(s).between(9, 15)), numbers, F.transform(secrets, lambda s: judged(s, no)),
    )
    some = F.size("_email") + F.size("_ip") + F.size("_card") + F.size("_phone") + F.size("_quoted") + F.size("_assigned") > 0
    every = F.concat(*(c.cast(f"array<{JUDGED}>") for c in spans))
    return found.select(*docs.columns, F.when(some, every).otherwise(empty(JUDGED)).alias("spans"))


def reliabilities(counts: list[tuple[str, str, int]]) -> dict[tuple[str, str], float]:
    """Posterior of each (kind, votes) by expectation-maximisation over pattern counts; a kind has its own reliabilities.

    Starts from the share of votes for 1.  Add-one smoothing keeps every reliability within 0 and 1.
    """
    out: dict[tuple[str, str], float] = {}
    for kind in sorted({k for k, _, _ in counts}):
        rows = sorted((v, n) for k, v, n in counts if k == kind)
        post = {v: (1 + v.count("1")) / (2 + v.count("1") + v.count("0")) for v, _ in rows}
        for _ in range(ROUNDS):
            total = sum(n for _, n in rows)
            prior = (1 + sum(n * post[v] for v, n in rows)) / (2 + total)
            yes = [[1.0] * 3 for _ in range(VOTERS)]
            no = [[1.0] * 3 for _ in range(VOTERS)]
            for v, n in rows:
                for i, c in enumerate(v):
                    yes[i][int(c)] += n * post[v]
                    no[i][int(c)] += n * (1 - post[v])
            post = {}
            for v, _ in rows:
                p, q = prior, 1 - prior
                for i, c in enumerate(v):
                    p *= yes[i][int(c)] / sum(yes[i])
                    q *= no[i][int(c)] / sum(no[i])
                post[v] = p / (p + q)
        out |= {(kind, v): p for v, p in post.items()}
    return out


@dataclass(frozen=True)
class Classifier:
    """A logistic span classifier: for each kind an offset, then a weight for each feature."""

    weights: dict[str, tuple[float, ...]]

    def takes(self, kind: str, flags: str, threshold: float = THRESHOLD) -> bool:
        own = self.weights.get(kind)
        return own is not None and own[0] + sum(w for w, f in zip(own[1:], flags, strict=True) if f == "1") >= np.log(threshold / (1 - threshold))

    def column(self, s: Column, threshold: float = THRESHOLD) -> Column:
        out = F.lit(False)
        for kind, (offset, *own) in sorted(self.weights.items()):
            total = F.lit(offset)
            for i, w in enumerate(own):
                total = total + F.when(F.substring(s["flags"], i + 1, 1) == "1", F.lit(w)).otherwise(F.lit(0.0))
            out = F.when(s["kind"] == kind, total >= float(np.log(threshold / (1 - threshold)))).otherwise(out)
        return out


def trained(counts: list[tuple[str, str, str, int]]) -> Classifier:
    """The span classifier, from counts by (kind, votes, flags): ridge-penalised likelihood of the posteriors, by Newton's method."""
    votes: dict[tuple[str, str], int] = {}
    for kind, v, _, n in counts:
        votes[kind, v] = votes.get((kind, v), 0) + n
    post, out = reliabilities([(k, v, n) for (k, v), n in votes.items()]), {}
    for kind in sorted({c[0] for c in counts}):
        own = sorted(c for c in counts if c[0] == kind)
        x = np.array([[1.0, *map(float, f)] for _, _, f, _ in own])
        y, n = np.array([post[k, v] for k, v, _, _ in own]), np.array([c[3] for c in own], float)
        n, w, penalty = n / n.sum(), np.zeros(1 + FLAGS), 1e-3 * np.eye(1 + FLAGS)
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (n * (y - p)) - penalty @ w)
            w = w + step / max(1.0, np.abs(step).max() / 4)
            if np.abs(step).max() < 1e-8:
                break
        out[kind] = tuple(float(v) for v in w)
    return Classifier(out)


def classifier_of(found: DataFrame) -> Classifier:
    counts = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes", "s.flags").count()
    return trained([tuple(r) for r in counts.collect()])  # at most 6 x 3**VOTERS x 2**FLAGS rows


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, added: arrays of (kind, start, end), start and end in code points, end exclusive; one row per input row.

    A null or empty text has no spans.  Rows that repeat and rows without doc_id are answered as they come.  base is in
    the order email, ip, card, phone, then start; spans of unlike kinds may overlap.  Time grows with a text's length, and with
    its matches but for a logarithm.  Other columns are ignored.
    """
    found = written(proposed(narrowed(docs, id_col, text_col)).drop("text"), "pii")
    classifier = classifier_of(found)
    place = lambda s: F.struct(s["kind"], s["start"], s["end"])
    base = F.transform(F.filter("spans", lambda s: s["base"]), place)
    added = F.transform(F.filter("spans", lambda s: ~s["base"] & classifier.column(s)), place)
    return found.select("doc_id", base.alias("base"), F.array_sort(added).alias("added"))


def between(chunks: Column, start: Column, end: Column) -> Column:
    """The text from start to end - 1, of its chunks of CHUNK characters: no walk over what stands before."""
    i, j = (start / CHUNK).cast("int"), ((end - 1) / CHUNK).cast("int")
    at = (start % CHUNK + 1).cast("int")
    first = F.substring(F.get(chunks, i), at, F.lit(CHUNK))
    last = F.substring(F.get(chunks, j), F.lit(1), (end - j * CHUNK).cast("int"))
    wide = F.concat(first, F.array_join(F.slice(chunks, i + 2, F.greatest(F.lit(0), j - i - 1)), ""), last)
    return F.when(start >= end, F.lit("")).when(i == j, F.substring(F.get(chunks, i), at, (end - start).cast("int"))).otherwise(wide)


def redacted(text: Column, spans: Column) -> Column:
    """text with each of the spans (start, end, kind), sorted, replaced by its kind in brackets; one that overlaps goes with those before."""

    def body(v: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            done = F.when(i > 0, F.get(v["cover"], i - 1)).otherwise(F.lit(0).cast("long"))
            name = F.when(s["start"] < done, F.lit("")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
            return F.when(s["end"] <= done, F.lit("")).otherwise(F.concat(between(v["chunks"], done, s["start"]), name))

        rest = between(v["chunks"], F.get(v["cover"], F.size(v["cover"]) - 1), v["n"])
        return F.concat(F.array_join(F.transform(v["spans"], piece), ""), rest)

    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), 0)
    cover = let(spans, lambda s: running(F.transform(s, lambda x: x["end"]), F.greatest))
    return let(F.struct(chunks.alias("chunks"), cover.alias("cover"), spans.alias("spans"), F.length(text).cast("long").alias("n")), body)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of its text replaced by its kind in brackets; overlapping spans by the first one's.

    Null texts stay null; all columns and rows stay, repeated ones and those without doc_id too.
    """
    names = docs.columns
    held = docs.select(F.struct(*(docs[c] for c in names)).alias("row"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    classifier = classifier_of(written(proposed(held.select("text")).select("spans"), "pii-votes"))
    found = proposed(held)
    taken = F.filter("spans", lambda s: s["base"] | classifier.column(s))
    found = found.withColumn("taken", F.array_sort(F.transform(taken, lambda s: F.struct(s["start"], s["end"], s["kind"]))))
    new = F.when(F.size("taken") > 0, redacted(F.col("text"), F.col("taken"))).otherwise(F.col("row")[text_col])
    return found.select(*(new.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in names))


def op4_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans")
    )
