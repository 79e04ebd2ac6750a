"""Toxicity by a learned lexicon: Levenshtein automata intersected with its trie, and context windows.

Terms are whole words or word beginnings that occur in more toxic documents of the training rows than chance would
give. The trie of the terms and the Levenshtein automaton of each (one edit from FUZZY letters on, none below) are
walked together into deterministic tables, which then reads all words of a block of texts at once, a letter at
a time. A match counts by its term, by exact or misspelled, and by its context: within quotation marks or after a
word of reporting it counts as quoted. Evidence of each kind is learned, and a logistic curve over a document's sum
and its strongest match gives the score.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm import batches as batch_rows
from sluice.llm import shingles
from sluice.plans import scratch

#: At most about so many labelled rows (by hash of their id) train the model.
TRAIN_ROWS = 8_000
#: Letters of the shortest term, of the longest word beginning (whole words may be longer), and from where on one edit
#: is allowed.
SHORTEST, LONGEST, FUZZY = 4, 64, 5
#: Terms that share one automaton: its table grows faster than its terms, so larger lexicons have several.
TOGETHER = 200
#: Chance of one false term in a whole lexicon.
FALSE_TERMS = 0.01
WINDOW = 80
#: Characters that are read together, and rows whose word beginnings are counted together.
BLOCK, COUNTED = 1 << 18, 250

# fixed values: quotation marks, and words of reporting in four languages
QUOTES = "\"“”„«»‘’‹›"
REPORTING = frozenset("said says wrote writes quoted quote called calls sagte sagt schrieb zitiert nannte dit écrit cité appelé dijo dice escribió citó llamó".split())

_DEAD, _OTHER = 0, 1
#: Signs that stand for a letter within a word.
_SYMBOLS = np.array([ord(c) for c in "*@$!"], np.uint32)


@cache
def _alphanumeric() -> np.ndarray:
    """Which code points are letters or digits."""
    return np.array([chr(cp).isalnum() for cp in range(0x110000)])



class Matcher:
    """Terms as (text, whole): whole ones must span the word, others start it."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        letters = sorted({c for t, _ in terms for c in t})
        self.classes = {c: i + 2 for i, c in enumerate(letters)}
        self._trie()
        self._table(len(letters) + 2)
        self.lut = np.where(_alphanumeric(), _OTHER, 0).astype(np.int16)
        for c, k in self.classes.items():
            for form in {c, c.upper(), c.title()}:
                if len(form) == 1:
                    self.lut[ord(form)] = k

    def _trie(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.fuzzy: list[bool] = [False]
        for k, (text, _) in enumerate(self.terms):
            node = 0
            for c in text:
                kid = self.next[node].get(self.classes[c])
                if kid is None:
                    kid = self.next[node][self.classes[c]] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.fuzzy.append(False)
                node = kid
            self.ends[node].append(k)
        # edits are allowed on the way to terms that are long enough
        def below(node: int) -> bool:
            own = any(len(self.terms[k][0]) >= FUZZY for k in self.ends[node])
            self.fuzzy[node] = any([below(kid) for kid in self.next[node].values()]) or own
            return self.fuzzy[node]

        below(0)

    def _closed(self, pairs: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        """With letters of a term left out; a node with fewer edits stands for the same with more."""
        whole = set(pairs)
        for node, edits in pairs:
            if edits == 0 and self.fuzzy[node]:
                whole |= {(kid, 1) for kid in self.next[node].values() if self.fuzzy[kid]}
        return frozenset((n, e) for n, e in whole if not (e and (n, 0) in whole))

    def _table(self, width: int) -> None:
        start = self._closed({(0, 0)})
        number, todo, rows = {frozenset(): _DEAD, start: 1}, deque([start]), {}
        while todo:
            state = todo.popleft()
            row = np.zeros(width, np.int32)
            for c in range(1, width):
                to = set()
                for node, edits in state:
                    kid = self.next[node].get(c)
                    if kid is not None and (edits == 0 or self.fuzzy[kid]):
                        to.add((kid, edits))
                    if edits == 0 and self.fuzzy[node]:
                        to.add((node, 1))
                        to |= {(kid, 1) for kid in self.next[node].values() if self.fuzzy[kid]}
                reached = self._closed(to)
                if reached not in number:
                    number[reached] = len(number)
                    todo.append(reached)
                row[c] = number[reached]
            rows[number[state]] = row
        self.step = np.zeros((len(number), width), np.int32)
        for at, row in rows.items():
            self.step[at] = row
        # what a state accepts, as 2 * term + edits, or -1: anywhere in a word, and at its end
        self.inside, self.atend = (np.full(len(number), -1, np.int32) for _ in "ab")
        for state, at in number.items():
            for whole, table in ((False, self.inside), (True, self.atend)):
                hits = [(e, -len(self.terms[k][0]), 2 * k + e) for n, e in state for k in self.ends[n] if self.terms[k][1] == whole and (e == 0 or len(self.terms[k][0]) >= FUZZY)]
                if hits:
                    table[at] = min(hits)[2]
        self.longest = max((len(t) for t, _ in self.terms), default=0) + 2

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(first character, end, term, edits) of each matching word of a text, in order."""
        if not self.terms or not text:
            return []
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        kind = self.lut[points]
        odd = np.flatnonzero(np.isin(points, _SYMBOLS))
        odd = odd[(odd > 0) & (odd < len(kind) - 1)]
        kind[odd[(kind[odd - 1] > 0) & (kind[odd + 1] > 0)]] = _OTHER
        inside = np.concatenate([[False], kind > 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        first, end = edge[::2], edge[1::2]
        best = np.full(len(first), -1, np.int32)
        live, state = np.arange(len(first)), np.ones(len(first), np.int32)
        for depth in range(self.longest):
            state = self.step[state, kind[first[live] + depth]]
            keep = state != _DEAD
            live, state = live[keep], state[keep]
            if not len(live):
                break
            last = first[live] + depth + 1 == end[live]
            for hit in (self.inside[state], np.where(last, self.atend[state], -1)):
                old = best[live]
                better = (hit >= 0) & ((old < 0) | (hit % 2 < old % 2))
                best[live[better]] = hit[better]
            live, state = live[~last], state[~last]
        found = np.flatnonzero(best >= 0)
        return list(zip(first[found].tolist(), end[found].tolist(), (best[found] // 2).tolist(), (best[found] % 2).tolist(), strict=True))


class Matchers:
    """A lexicon of any size, as one automaton for every TOGETHER terms in order."""

    def __init__(self, terms: list[tuple[str, bool]]):
        self.terms = terms
        order = sorted(range(len(terms)), key=lambda k: terms[k])
        self.parts = [(part, Matcher([terms[k] for k in part])) for part in (order[i : i + TOGETHER] for i in range(0, len(order), TOGETHER))]

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(first character, end, term, edits) of each matching word: with fewest edits, then the longest term."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for numbers, matcher in self.parts:
            for first, end, k, edits in matcher.find(text):
                term = numbers[k]
                rank = (edits, -len(self.terms[term][0]), term)
                if (first, end) not in best or rank < best[first, end]:
                    best[first, end] = rank
        return [(first, end, term, edits) for (first, end), (edits, _, term) in sorted(best.items())]


def quoted(text: str, first: int, end: int) -> bool:
    """Whether the window around a match shows quotation: marks on both sides of it, or a word of reporting before."""
    left, right = text[max(0, first - WINDOW) : first], text[end : end + WINDOW]
    left, right = left.rpartition("\n")[2], right.partition("\n")[0]
    if sum(left.count(q) for q in QUOTES) % 2 and any(q in right for q in QUOTES):
        return True
    return any(w.strip(".,:;" + QUOTES).lower() in REPORTING for w in left.split()[-5:])


def evidence(batch: pa.Array, matcher: Matchers) -> list[list[int]]:
    """For each text its distinct kinds of match, as 4 * term + 2 * edits + quoted, ascending."""
    out: list[list[int]] = []
    texts = batch.to_pylist()
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") < BLOCK):
            size += len(texts[end] or "") + 1
            end += 1
        whole = "\n".join(t or "" for t in texts[at:end])
        ends = np.cumsum([len(t or "") + 1 for t in texts[at:end]])
        kinds: list[set[int]] = [set() for _ in range(end - at)]
        found = matcher.find(whole)
        rows = np.searchsorted(ends, [f[0] for f in found], "right")
        for (a, b, term, edits), row in zip(found, rows.tolist(), strict=True):
            kinds[row].add(4 * term + 2 * edits + quoted(whole, a, b))
        out += [sorted(k) for k in kinds]
        at = end
    return out


@batch_rows.returning
def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest shingle of each text: near copies mostly share it."""
    for batch in batches:
        for start, end, data, offsets in shingles.blocks(batch.column(1)):
            least = [int(s[0]) if len(s) else 0 for s in shingles.shingle_sets(data, offsets)]
            part = batch.slice(start, end - start)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(least, np.uint64).view(np.int64))], ["toxic", "text", "copy"])


@batch_rows.returning
def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents that hold each word (marked by a final space) and word beginning, toxic and clean."""
    for batch in (b.slice(at, COUNTED) for b in batches for at in range(0, len(b), COUNTED)):
        seen = (Counter(), Counter())
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = {w for w in "".join(c if c.isalnum() else " " for c in (text or "").lower()).split() if len(w) >= SHORTEST}
            seen[toxic].update({w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)} | {f"{w} " for w in words})
        terms = [*seen[1], *(t for t in seen[0] if t not in seen[1])]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], ["term", "toxic", "clean"])


def _tail(t: int, n: int, rate: float) -> float:
    """Log of the chance of t or more of n at a rate, from above."""
    if t <= n * rate:
        return 0.0
    p = t / n
    return -n * (p * math.log(p / rate) + ((1 - p) * math.log((1 - p) / (1 - rate)) if p < 1 else 0.0))


def choose(counts: list[tuple[str, int, int]], toxic: int, clean: int, tested: int) -> list[tuple[str, bool]]:
    """Terms (text, whole) of a lexicon from (term, toxic, clean) document counts.

    A term is kept if its share of toxic documents is beyond chance among all terms tested; of nested terms, the
    longest that loses few documents, and then nothing longer.
    """
    rate = toxic / max(1, toxic + clean)
    need = math.log(FALSE_TERMS / max(1, tested))
    good = {w: t for w, t, c in counts if t >= 3 and _tail(t, t + c, rate) < need and (t / max(1, toxic)) > 10 * (c / max(1, clean))}
    kept: list[str] = []
    for w in sorted(good, key=lambda w: (len(w.rstrip()), w)):
        if any(w.startswith(k.rstrip()) for k in kept):
            continue
        best = max((x for x in good if x.startswith(w) and good[x] >= 0.9 * good[w]), key=lambda x: (len(x), x))
        if best not in kept:
            kept.append(best)
    kept.sort(key=lambda w: (-good[w], w))
    return [(w.rstrip(), w.endswith(" ")) for w in kept]


class Model:
    """A matcher, weights of kinds of match, and the curve."""

    def __init__(self, terms: list[tuple[str, bool]], rows: list[tuple[int, list[int]]] = (), base: float = 0.01):
        self.matcher = Matchers(terms)
        total, seen = [0, 0], (Counter(), Counter())
        for toxic, kinds in rows:
            total[toxic] += 1
            seen[toxic].update(kinds)
        self.weights = {k: math.log((seen[1][k] + 0.2) / (total[1] + 1)) - math.log((seen[0][k] + 0.2) / (total[0] + 1)) for k in {*seen[0], *seen[1]}}
        self.base = base
        self.curve = self._fit(rows) if min(total) else np.array([math.log(base / (1 - base)), 0.5, 0.5])

    def traits(self, kinds: list[int]) -> tuple[float, float, float]:
        """1, the capped sum and the largest weight. Kinds not met in training count as their exact, unquoted kind, less."""
        values = [self.weights[k] if k in self.weights else 0.3 * self.weights.get(4 * (k // 4), 0.0) for k in kinds]
        values = [v for v in values if v > 0]
        return 1.0, min(15.0, sum(values)), max(values, default=0.0)

    def _fit(self, rows) -> np.ndarray:
        x = np.array([self.traits(k) for _, k in rows])
        y = np.array([t for t, _ in rows], float)
        w, small = np.zeros(3), np.diag([1e-3, 0.1, 0.1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + small, x.T @ (y - p) - small @ w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        return w

    def score(self, texts: pa.Array) -> np.ndarray:
        x = np.array([self.traits(k) for k in evidence(texts, self.matcher)]).reshape(-1, 3)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """One row in five, by crc32 of the id as text; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@batch_rows.returning
def _kinds(batches: Iterator[pa.RecordBatch], matcher) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(evidence(batch.column(1), matcher.value), pa.list_(pa.int32()))], ["toxic", "kinds"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows of ``docs`` that are not held out, at most about TRAIN_ROWS of them.

    Labels join by doc_id; null labels and ids are left out, near copies count once. Without labels of both kinds
    the model knows no term and scores every text alike.
    """
    spark = docs.sparkSession
    batch_rows.bound(spark)
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    share = min(1.0, TRAIN_ROWS / max(1, usable.count()))
    usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # TRAIN_ROWS rows of two numbers
    rows = docs.select("doc_id", "text").join(F.broadcast(usable), "doc_id").select("toxic", "text")
    rows = rows.mapInArrow(_groups, "toxic int, text string, copy long").groupBy("copy").agg(F.min_by("toxic", F.xxhash64("text")).alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = scratch.keep(rows.select("toxic", "text"), "training")
    size = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not size.get(0) or not size.get(1):
        return Model([])
    counts = rows.mapInArrow(_beginnings, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = scratch.keep(counts, "beginnings")
    tested = counts.count()
    likely = counts.where(F.col("toxic") >= 3).where(F.col("toxic") * size[0] > 10 * F.col("clean") * size[1])
    # terms of the training rows only, whose number is bounded, and of these only those beyond chance
    n, rate = F.col("toxic") + F.col("clean"), F.lit(size[1] / (size[0] + size[1]))
    p = F.col("toxic") / n
    tail = n * (p * F.ln(p / rate) + F.when(p < 1, (1 - p) * F.ln((1 - p) / (1 - rate))).otherwise(0.0))
    likely = likely.where((p > rate) & (tail > 0.99 * -math.log(FALSE_TERMS / max(1, tested))))
    terms = choose(sorted(tuple(r) for r in likely.collect()), size[1], size[0], tested)
    matcher = spark.sparkContext.broadcast(Matchers(terms))
    seen = [(r["toxic"], r["kinds"]) for r in rows.mapInArrow(partial(_kinds, matcher=matcher), "toxic int, kinds array<int>").collect()]
    return Model(terms, seen, size[1] / (size[0] + size[1]))


@batch_rows.returning
def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model.value.score(batch.column(batch.num_columns - 1)))], [*batch.schema.names[:-1], "score"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text).

    Only the text decides a score: equal texts score alike. Null and empty texts score as texts without a match.
    Repeated rows are each scored; no rows give none; other columns are not read. One pass, no shuffle.
    """
    batch_rows.bound(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = rows.mapInArrow(partial(_scored, model=shared), f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@batch_rows.returning
def _accepted(batches: Iterator[pa.RecordBatch], model, at: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(model.value.score(batch.column(at)) < 0.5))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, unchanged. One pass, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(partial(_accepted, model=shared, at=docs.columns.index("text")), docs.schema)
