"""Substring dedup by MinHash banding of paragraphs and of the windows inside them.

A paragraph is a line of LONG words or more, or a run of shorter lines without an empty line between them, of LONG
words or more. It gets a MinHash signature in BANDS bands of ROWS values (a pair at 0.75 shares none with a chance of
about 1e-3). Paragraphs that collide are compared by signature, confirmed by the exact Jaccard likeness of their
five-word shingles, and joined to components: neighbours in a band first, then all pairs that are still apart and
that an exact prefix filter on the full sets leaves.
A passage that repeats within other paragraphs is found by its windows: every window of 2 * GRAM words keeps the
smallest hash of its runs of GRAM words, one band for each, so that two texts that share any 2 * GRAM words in a row
share a kept run, whatever surrounds them. A kept run that repeats is a seed. Seeds that follow each other as their
first occurrences do are one passage, which grows to both sides, word by word, as far as the text agrees with that of
the first occurrences. Components of paragraphs and classes of runs keep their first occurrence; the others, joined
where they touch, become spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm import batches as batch_rows
from sluice.llm import near_dedup, shingles
from sluice.llm.components import connected
from sluice.operators.patterns import looked_up
from sluice.plans import scratch

BANDS, ROWS, LONG, GRAM, GAP = 8, 2, 20, 25, 8
#: Signatures of 16 values at a likeness of 0.75 agree on less than 6 with a chance of about 4e-4.
SURE = 0.375
#: Neighbours in a band that are compared first, in chunks of REGION.
NEAR, REGION = 2, 64
#: Words around a seed that it may grow into: beyond them the passage holds another seed.
SIDE = GRAM + 1
#: Seeds whose first words are so far apart or less are joined by their places alone: what a seed grows into on the side
#: of another one is covered by that one, or lies between them.
STEP = GRAM + GAP

_draw = np.random.default_rng(505)
_LOW, _HIGH = (_draw.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1) for _ in "lh")


def _paragraphs(data: np.ndarray, begin: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words of the paragraphs of LONG words or more, and of what follows each."""
    n = len(begin)
    lines = np.cumsum(data == 10)[begin]
    new = np.ones(n, bool)
    new[1:] = lines[1:] != lines[:-1]
    text = np.zeros(n, bool)
    text[first[:-1][first[:-1] < first[1:]]] = True
    at = np.flatnonzero(new | text)
    size = np.diff(np.append(at, n))
    # short lines without an empty line between them are one paragraph
    apart = np.ones(len(at), bool)
    apart[1:] = text[at[1:]] | (lines[at[1:]] - lines[at[:-1]] > 1) | (size[1:] >= LONG) | (size[:-1] >= LONG)
    at = at[apart]
    end = np.append(at[1:], n)
    keep = end - at >= LONG
    return at[keep], end[keep]


def _sliding(x: np.ndarray, n: int, of, fill: int) -> np.ndarray:
    """``of`` over x[i : i + n] for each i, with ``fill`` beyond the end."""
    out, width = x, 1
    while width < n:
        step = min(width, n - width)
        out = of(out, np.concatenate([out[step:], np.full(step, fill, np.uint64)])[: len(out)])
        width += step
    return out


def _windows(total: np.ndarray, first: np.ndarray) -> np.ndarray:
    """First words of the kept runs: smallest in one of the GRAM + 1 runs in a row that hold it."""
    n = len(total) - 1
    if n < GRAM:
        return np.zeros(0, np.int64)
    down = shingles._power(n + 1)[1]
    top = (1 << 64) - 1
    value = np.full(n, top, np.uint64)
    rows = n - GRAM + 1
    whole = np.searchsorted(first, np.arange(rows), "right") == np.searchsorted(first, np.arange(rows) + GRAM - 1, "right")
    value[:rows][whole] = shingles.mix((total[GRAM:] - total[:-GRAM]) * down[:rows])[whole]
    least = _sliding(value, GRAM + 1, np.minimum, top)
    # the largest minimum of the windows that hold a run is the run itself, if any keeps it
    held = _sliding(np.concatenate([least[::-1]]), GRAM + 1, np.maximum, 0)[::-1]
    kept = (held == value) & (value != top)
    kept[1:] &= value[1:] != value[:-1]
    return np.flatnonzero(kept)


def _folded(runs: np.ndarray, doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which kept runs stand for all, and how many words each covers: GRAM, or up to the end of the next one listed.

    Where one run follows itself at one distance of GRAM words or less, the words between repeat. Runs that lie STEP
    words or more from both ends of such a stretch see the same words around them as runs near its ends do, grow into
    nothing outside it, and follow no other seed: those near the ends stand for them, however long the stretch is.
    """
    step = np.diff(runs)
    gap = np.where((doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (step <= GRAM), step, 0)
    begins = np.flatnonzero(np.append(True, gap[1:] != gap[:-1])) if len(gap) else gap
    of = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(gap))))[1:]
    within = (gap[1:] == gap[:-1]) & (gap[1:] > 0)
    least, last = runs[begins], runs[np.append(begins[1:], len(gap))] if len(gap) else runs
    keep = np.ones(len(runs), bool)
    keep[1:-1] = ~(within & (runs[1:-1] - least[of] >= STEP) & (last[of] - runs[1:-1] >= STEP))
    at = np.flatnonzero(keep)
    words = np.full(len(at), GRAM, np.int32)
    words[:-1] += (np.diff(runs[at]) * (np.diff(at) > 1)).astype(np.int32)
    return at, words


def _rolled(value: np.ndarray) -> np.ndarray:
    rows = len(value) - shingles.SHINGLE + 1
    if rows < 1:
        return np.zeros(0, np.uint64)
    out = value[:rows].copy()
    for k in range(1, shingles.SHINGLE):
        out *= shingles._STEP
        out += value[k : k + rows]
    return shingles.mix(out)


def _block(data: np.ndarray, offsets: np.ndarray):
    """Words of a block with their running sums and characters, or None if it has none."""
    value, begin, end, first = shingles.words(data, offsets)
    if not len(value):
        return None
    up, down = shingles._power(len(value) + 1)
    total = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(value * up[: len(value)], out=total[1:])
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return value, begin, end, first, total, down, chars


def _key(total: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the words from a to b."""
    return shingles.mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)).view(np.int64)


def _lists(values: np.ndarray, kind: pa.DataType, inside: np.ndarray | None = None) -> pa.ListArray:
    """A matrix as lists, null where not ``inside``."""
    at = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.ravel(), kind, mask=None if inside is None else ~inside.ravel()))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept runs (sig null) and long paragraphs (with sig) of texts, by the key of their words.

    n_words of a run is GRAM, or reaches over the runs that are folded behind it.
    own tells texts that share an id apart: 31 bits of a hash of their words.
    """
    names = ["doc_id", "own", "word", "n_words", "first", "end", "key", "sig", "run"]
    for batch in batches:
        for start, _, data, offsets in shingles.blocks(batch.column(1)):
            block = _block(data, offsets)
            if block is None:
                continue
            value, begin, end, first, total, down, chars = block
            own = (_key(total, down, first[:-1], first[1:]) & 0x7FFFFFFF).astype(np.int32)
            runs = _windows(total, first)
            doc = np.searchsorted(first, runs, "right") - 1
            key = _key(total, down, runs, runs + GRAM)
            at, covered = _folded(runs, doc, key)
            runs, doc, key = runs[at], doc[at], key[at]
            none = pa.nulls(len(runs), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(start + doc)),
                    pa.array(own[doc]),
                    pa.array((runs - first[doc]).astype(np.int32)),
                    pa.array(covered),
                    none,
                    none,
                    pa.array(key),
                    pa.nulls(len(runs), pa.list_(pa.int32())),
                    pa.array(np.ones(len(runs), bool)),
                ],
                names,
            )
            a, b = _paragraphs(data, begin, first)
            if not len(a):
                continue
            doc = np.searchsorted(first, a, "right") - 1
            roll = np.append(_rolled(value), np.uint64(0))
            low, high = roll.astype(np.uint32), (roll >> np.uint64(32)).astype(np.uint32)
            spans = np.stack([a, b - shingles.SHINGLE + 1], 1).ravel()
            sig = np.stack([np.minimum.reduceat(low * x ^ high * y, spans)[::2] for x, y in zip(_LOW, _HIGH, strict=True)], 1)
            origin = chars[offsets[doc]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(start + doc)),
                    pa.array(own[doc]),
                    pa.array((a - first[doc]).astype(np.int32)),
                    pa.array((b - a).astype(np.int32)),
                    pa.array((chars[begin[a]] - origin).astype(np.int64)),
                    pa.array((chars[end[b - 1]] - origin).astype(np.int64)),
                    pa.array(_key(total, down, a, b)),
                    _lists(sig.view(np.int32), pa.int32()),
                    pa.array(np.zeros(len(a), bool)),
                ],
                names,
            )


def _closer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words around the listed passages of a text (runs from key to last), and the shingle sets of its listed paragraphs."""
    names = ["doc_id", "word", "n_words", "key", "last", "head_doc", "kept", "n", "first", "end", "before", "after", "left", "right", "shingles"]
    step = np.arange(SIDE)
    for batch in batches:
        for start, stop, data, offsets in shingles.blocks(batch.column(1)):
            block = _block(data, offsets)
            if block is None:
                continue
            value, begin, end, first, total, down, chars = block
            lists = batch.column(2).slice(start, stop - start)
            row = np.repeat(np.arange(stop - start), lists.value_lengths().to_numpy())
            places = lists.flatten()
            fields = dict(zip((f.name for f in places.type), places.flatten(), strict=True))
            last = fields.get("last", fields["key"])
            word, size, key, run = (fields[c].to_numpy(zero_copy_only=False) for c in ("word", "n_words", "key", "run"))
            a = first[row] + word
            # texts that share an id are told apart by the words themselves
            fits = a + size <= first[row + 1]
            ends = np.where(run, GRAM, size)
            fits[fits] = _key(total, down, a[fits], (a + ends)[fits]) == key[fits]
            both = np.flatnonzero(fits & run)
            fits[both] = _key(total, down, (a + size)[both] - GRAM, (a + size)[both]) == last.take(pa.array(both)).to_numpy()
            origin, opens, closes = chars[offsets], chars[begin], chars[end]

            def rows(keep: np.ndarray) -> list[pa.Array]:
                at, b = a[keep], (a + size)[keep]
                return [
                    batch.column(0).take(pa.array(start + row[keep])),
                    pa.array(word[keep]),
                    pa.array(size[keep]),
                    pa.array(key[keep]),
                    *(x.take(pa.array(keep)) for x in (last, fields["head_doc"], fields["kept"], fields["n"])),
                    pa.array(opens[at] - origin[row[keep]]),
                    pa.array(closes[b - 1] - origin[row[keep]]),
                ]

            keep = np.flatnonzero(fits & run)
            if len(keep):
                back, on = a[keep][:, None] - 1 - step, (a + size)[keep][:, None] + step
                has_back, has_on = back >= first[row[keep]][:, None], on < first[row[keep] + 1][:, None]
                back, on = np.maximum(back, 0), np.minimum(on, len(value) - 1)
                sides = [_lists((value[x] & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16), pa.int16(), has) for x, has in ((back, has_back), (on, has_on))]
                left, right = (opens[np.minimum(back + 1, len(value) - 1)] - opens[back]) * has_back, (closes[on] - closes[np.maximum(on - 1, 0)]) * has_on
                yield pa.RecordBatch.from_arrays([*rows(keep), *sides, _lists(left.astype(np.int32), pa.int32()), _lists(right.astype(np.int32), pa.int32()), pa.nulls(len(keep), pa.list_(pa.int64()))], names)
            keep = np.flatnonzero(fits & ~run)
            if len(keep):
                roll = _rolled(value)
                sets = [np.unique(roll[x : y - shingles.SHINGLE + 1]).view(np.int64) for x, y in zip(a[keep].tolist(), (a + size)[keep].tolist(), strict=True)]
                ends = pa.array(np.cumsum([0] + [len(s) for s in sets]).astype(np.int32))
                none = [pa.nulls(len(keep), pa.list_(t)) for t in (pa.int16(), pa.int16(), pa.int32(), pa.int32())]
                yield pa.RecordBatch.from_arrays([*rows(keep), *none, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], names)


def _headed(rows: DataFrame, on: str, least: int = 1) -> DataFrame:
    """``rows`` of groups of ``least`` or more, with the group's size (n), its first document (head_doc), and whether kept.

    The first occurrence in that document is kept; head_word and head_own are its word and text.
    """
    heads = rows.groupBy(on).agg(F.count("*").alias("n"), F.min("doc_id").alias("head_doc")).where(F.col("n") >= least)
    heads = scratch.keep(heads, "heads")
    held = scratch.keep(looked_up(rows, heads, [on], size="n"), "held")
    place = F.shiftleft(F.col("word").cast("long"), 31) + F.col("own")  # one number, for a hash aggregate
    words = held.where("doc_id = head_doc").groupBy(on, "n").agg(F.min(place).alias("place"))
    at = [F.shiftright("place", 31).cast("int").alias("head_word"), F.col("place").bitwiseAND(0x7FFFFFFF).cast("int").alias("head_own")]
    words = scratch.keep(words.select(on, "n", *at), "words")
    headed = looked_up(held.drop("n"), words, [on], size="n")
    kept = (F.col("doc_id") == F.col("head_doc")) & (F.col("word") == F.col("head_word"))
    headed = scratch.keep(headed.withColumn("kept", kept), "headed")
    scratch.release(heads, held, words)
    return headed


def _chains(seeds: DataFrame) -> DataFrame:
    """(doc_id, word, n_words, key, last, head_doc, head_word): passages from a first seed (key) to a last one.

    They hold the seeds that are not kept and follow each other in a text, by STEP words or less, as their first
    occurrences do in head_doc, from head_word on. So all seeds of a passage would grow over the same words of both
    texts: only the first can pass the left end, and only the last the right one.
    """
    seeds = seeds.where("NOT kept").withColumn("shift", F.col("word") - F.col("head_word"))
    row = Window.partitionBy("doc_id", "own", "head_doc", "head_own", "shift").orderBy("word")
    seeds = seeds.withColumn("open", F.when(F.coalesce(F.col("word") - F.lag("word").over(row) > STEP, F.lit(True)), 1).otherwise(0))
    seeds = seeds.withColumn("chain", F.sum("open").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    chains = seeds.groupBy("doc_id", "own", "head_doc", "head_own", "shift", "chain").agg(F.min("word").alias("word"), F.max("word").alias("end"), F.min_by("key", "word").alias("key"), F.max_by("key", "word").alias("last"))
    return chains.select("doc_id", "word", (F.col("end") - F.col("word") + GRAM).cast("int").alias("n_words"), "key", "last", "head_doc", (F.col("word") - F.col("shift")).alias("head_word"))


def _distinct(paragraphs: DataFrame) -> DataFrame:
    """One row a different paragraph: key, its first document and word there, n_words, sig, and how often it occurs."""
    heads = scratch.keep(paragraphs.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("head_doc")), "heads")
    first = looked_up(paragraphs.select("key", "doc_id", "word", "n_words", "sig"), heads, ["key"], size="n").where("doc_id = head_doc")
    first = scratch.keep(first.groupBy("key", "doc_id", "n").agg(F.min("word").alias("word"), F.any_value("n_words").alias("n_words"), F.any_value("sig").alias("sig")), "paragraphs")
    scratch.release(heads)
    return first


def _bands(first: DataFrame) -> DataFrame:
    """(band, node, members) of different paragraphs that share a band with another."""
    bands = F.array(*(F.xxhash64(F.lit(b), *(F.col("sig")[b * ROWS + r] for r in range(ROWS))) for b in range(BANDS)))
    return near_dedup.shared(first.select(F.explode(bands).alias("band"), F.col("key").alias("node")))


def _components(first: DataFrame, bands: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, component) of different paragraphs that are alike, directly or through others."""
    table = first.select(F.col("key").alias("doc_id"), "sig", F.lit(1).alias("n_shingles"))
    chunk = F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("members") / REGION))
    order = Window.partitionBy("band", chunk).orderBy("node")
    near = bands.select("node", F.array(*(F.lag("node", k).over(order) for k in range(1, NEAR + 1))).alias("near"))
    near = near.select(F.col("node").alias("b"), F.explode("near").alias("a")).where("a IS NOT NULL")
    likely = scratch.keep(near_dedup.likely(near, table, SURE).select("a", "b"), "likely")
    links = scratch.keep(near_dedup.confirmed(likely, lambda pairs: sets), "links")
    # families that neighbours left in parts: every member with the first and the last of its band
    held = near_dedup.held_apart(bands, connected(links))
    ends = held.groupBy("band").agg(F.max("members").alias("size"), *(f("node").alias(n) for f, n in ((F.min, "low"), (F.max, "high"))), F.min_by("own", "node").alias("own_low"), F.max_by("own", "node").alias("own_high"))
    star = looked_up(held, scratch.keep(ends, "ends"), ["band"], size="size")
    star = star.select("node", "own", F.explode(F.array(F.struct(F.col("low").alias("head"), F.col("own_low").alias("at")), F.struct(F.col("high").alias("head"), F.col("own_high").alias("at")))).alias("end"))
    star = star.where("own <> end.at").select(F.least("node", "end.head").alias("a"), F.greatest("node", "end.head").alias("b"))
    more = scratch.keep(near_dedup.likely(star, table, SURE).select("a", "b").join(likely, ["a", "b"], "left_anti"), "star")
    links = links.union(scratch.keep(near_dedup.confirmed(more, lambda pairs: sets), "links"))
    return near_dedup.settled(links, likely.union(more), bands, table, lambda pairs: sets, SURE)


def _agreeing(x: str, y: str) -> Column:
    """How many values two arrays share from their beginnings on."""
    differs = F.array_position(F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False))), F.lit(False))
    return F.when(differs == 0, F.size(x)).otherwise(differs - 1).cast("int")


def _grown(runs: DataFrame) -> DataFrame:
    """Passages grown to both sides as far as they agree with their first occurrence; that one as far as any does."""
    heads = runs.where("kept").dropDuplicates(["key", "last"])
    heads = scratch.keep(heads, "heads")
    around = heads.select("key", "last", "n", F.col("before").alias("head_before"), F.col("after").alias("head_after"))
    others = looked_up(runs.where("NOT kept").drop("n"), around, ["key", "last"], size="n")
    others = others.withColumns({"l": _agreeing("before", "head_before"), "r": _agreeing("after", "head_after")})
    columns = ["doc_id", "word", "n_words", "first", "end", "key", "last", "head_doc", "kept", "left", "right", "l", "r"]
    others = scratch.keep(others.select(*columns), "others")
    most = others.groupBy("key", "last").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    every = others.union(heads.join(most, ["key", "last"]).select(*columns))
    sum_of = lambda steps, n: F.aggregate(F.slice(steps, F.lit(1), F.col(n)), F.lit(0), lambda s, x: s + x)
    words = (F.col("n_words") + F.col("l") + F.col("r")).cast("int")
    return every.select("doc_id", (F.col("word") - F.col("l")).alias("word"), words.alias("n_words"), (F.col("first") - sum_of("left", "l")).alias("first"), (F.col("end") + sum_of("right", "r")).alias("end"), "head_doc", "kept")


UNITS = "own int, word int, n_words int, first long, end long, key long, sig array<int>, run boolean"


def _closer_schema(kind: str) -> str:
    return f"doc_id {kind}, word int, n_words int, key long, last long, head_doc {kind}, kept boolean, n long, first long, end long, before array<smallint>, after array<smallint>, left array<int>, right array<int>, shingles array<long>"


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, first, end, n_words, head_doc, kept): spans of ``docs`` (doc_id, text) that repeat.

    first and end are characters of the text; head_doc is the document of the first occurrence (by doc_id, then
    place), whose span is kept and returned too. Long paragraphs repeat if their five-word shingles have a likeness
    of 0.75 or more, directly or through others; passages if their words are equal, letter case of A-Z apart: any
    2 * GRAM words that two documents share are found, with all words around them that agree with the first
    occurrence. Runs and paragraphs that follow each other by GAP words or less and share head_doc make one span.
    Texts that are null, empty or without words have none; equal rows repeat each other; rows without an id are not
    looked at; rows that share an id are told apart by their words; an empty table gives none. Other columns are not
    read. Texts are shuffled once, to the documents' repeated places.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    batch_rows.bound(docs.sparkSession)
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    units = scratch.keep(docs.mapInArrow(_units, f"doc_id {kind}, {UNITS}"), "units", by="run")
    seeds = _headed(units.where("run").select("doc_id", "own", "word", "n_words", "key"), "key", 2)
    scratch.release(units, part="run=true")
    chains = scratch.keep(_chains(seeds), "chains")
    # the middle of stretches that repeat: passages at both ends have the characters
    middle = seeds.where(F.col("n_words") > GRAM).select("doc_id", "word", "n_words", *(F.lit(None).cast("long").alias(c) for c in ("first", "end")), "head_doc", F.lit(False).alias("kept"))
    middle = scratch.keep(middle, "middle")
    scratch.release(seeds)
    # where their first occurrences lie follows from the two seeds
    heads = chains.groupBy("key", "last").agg(F.count("*").alias("n"), *(F.min(c).alias(c) for c in ("head_doc", "head_word", "n_words")))
    heads = scratch.keep(heads, "heads")
    paragraphs = units.where("NOT run").drop("run")
    first = _distinct(paragraphs)
    bands = _bands(first)
    crowded = scratch.keep(first.join(bands.select(F.col("node").alias("key")).distinct(), "key", "left_semi"), "crowded")

    none = [F.lit(None).cast(t).alias(c) for c, t in (("head_doc", kind), ("kept", "boolean"), ("n", "long"), ("last", "long"))]
    fields = ["head_doc", F.lit(False).alias("kept"), none[2], "last"]
    places = chains.select("doc_id", F.struct("word", "n_words", "key", F.lit(True).alias("run"), *fields).alias("place"))
    fields = ["head_doc", F.lit(True).alias("kept"), "n", "last"]
    places = places.union(heads.select("head_doc", F.struct(F.col("head_word").alias("word"), "n_words", "key", F.lit(True).alias("run"), *fields)))
    places = places.union(crowded.select("doc_id", F.struct("word", "n_words", "key", F.lit(False).alias("run"), *none)))
    # as many places as a document has words, at most
    listed = places.groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    closer = docs.join(listed, "doc_id").select("doc_id", "text", "places")
    closer = closer.mapInArrow(_closer, _closer_schema(kind)).withColumn("run", F.col("shingles").isNull())
    closer = scratch.keep(closer, "closer", by="run")
    scratch.release(chains, heads)
    passages = scratch.keep(_grown(closer.where("run").drop("shingles", "run")), "passages")
    scratch.release(closer, part="run=true")

    groups = _components(crowded, bands, closer.where("NOT run").select(F.col("key").alias("node"), "shingles"))
    alike = first.join(groups.withColumnRenamed("node", "key"), "key", "left").where("n > 1 OR component IS NOT NULL")
    alike = scratch.keep(alike.select("key", "n", F.coalesce("component", "key").alias("component")), "alike")
    near = looked_up(paragraphs.drop("sig"), alike, ["key"], size="n").drop("n")
    near = _headed(scratch.keep(near, "near"), "component")

    found = passages.unionByName(near.select(*passages.columns)).unionByName(middle)
    row = Window.partitionBy("doc_id", "head_doc", "kept").orderBy("word", F.desc("n_words"))
    reach = F.max(F.col("word") + F.col("n_words")).over(row.rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("open", F.when(F.coalesce(F.col("word") > reach + GAP, F.lit(True)), 1).otherwise(0))
    found = found.withColumn("run", F.sum("open").over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = found.groupBy("doc_id", "head_doc", "kept", "run").agg(F.min("first").alias("first"), F.max("end").alias("end"), (F.max(F.col("word") + F.col("n_words")) - F.min("word")).cast("int").alias("n_words"))
    return spans.select("doc_id", "first", "end", "n_words", "head_doc", "kept")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            parts, at = [], 0
            for s in sorted(spans or [], key=lambda s: s["first"]):
                parts.append((text or "")[at : s["first"]] if s["first"] > at else "")
                at = max(at, s["end"])
            out.append(None if text is None else "".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])


def without_repeats(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text) of ``docs`` without the spans that are not kept. Null texts stay null."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = spans.where("NOT kept").groupBy("doc_id").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    return docs.select("doc_id", "text").join(cut, "doc_id", "left").mapInArrow(_cut, f"doc_id {kind}, text string")
