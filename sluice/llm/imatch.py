"""I-Match document fingerprints, in DataFrame functions only.

The lexicon is the terms whose document frequency over the whole corpus lies in a band, as shares of all documents.
A text's distinct terms are sorted, and those in each of SUBSETS randomised subsets of the lexicon are hashed. The
subsets come in levels: the EACH subsets of a level are disjoint and hold 1 / (EACH * rate) of the lexicon each, so
that short and long texts both have levels at which a subset holds one or a few of their terms: there, a subset
survives most edits and unrelated texts differ. A subset's hash is the exclusive or of two mixed hashes of its
terms, which a hash aggregate keeps in two numbers: as with a digest of the sorted terms, only the set matters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.plans import scratch

#: Band of document frequency: at most (terms a document) / LOW terms are in it, whatever the corpus.
LOW, HIGH = 0.001, 0.15
LEVELS, EACH = (1, 4, 16, 64, 256), 10
SUBSETS = len(LEVELS) * EACH
#: Lexicons of more terms are joined by a shuffle, but for terms of this share of all documents.
BROADCAST_TERMS, COMMON = 2_000_000, 0.01
EMPTY = "-"


def terms(text: Column) -> Column:
    """Hashes of the distinct words (letters and digits, lower case) of a text, sorted."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.sort_array(F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit(""))))


def lexicon(docs: DataFrame, count: int, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, slot, count): terms of the band over all of ``docs``, once for each subset that holds them (4 / 3 on average)."""
    seen = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").count()
    band = seen.where((F.col("count") >= F.lit(low * count)) & (F.col("count") <= F.lit(max(1.0, high * count))))
    draw = [F.pmod(F.xxhash64("term", F.lit(k)), F.lit(EACH * rate)) for k, rate in enumerate(LEVELS)]
    slots = F.array(*(F.when(d < EACH, (d + k * EACH).cast("int")) for k, d in enumerate(draw)))
    return band.select("term", "count", F.explode(slots).alias("slot")).where("slot IS NOT NULL").select("term", "slot", "count")


def _with_slots(flat: DataFrame, words: DataFrame, count: int) -> DataFrame:
    """``flat`` (hit_term, bucket, place, pos and others) with the slots of its terms, null for terms without one.

    The lexicon is broadcast if it is small. If not, its frequent terms are (they have COMMON of all documents, so there
    are at most (terms a document) / COMMON of them), and the others meet their slots by a shuffle, in which rows that
    need no slot are spread.
    """
    if words.count() <= BROADCAST_TERMS:
        return flat.join(F.broadcast(words.drop("count")), F.col("hit_term") == F.col("term"), "left")
    often = F.col("count") >= F.lit(COMMON * count)
    common = words.where(often).select(F.col("term").alias("common_term"), F.col("slot").alias("common_slot"))
    marked = flat.join(F.broadcast(common), F.col("hit_term") == F.col("common_term"), "left")
    open_ = F.col("common_term").isNull() & F.col("hit_term").isNotNull()
    spot = F.when(open_, F.col("hit_term")).otherwise(F.xxhash64("bucket", "place", "pos"))
    marked = marked.withColumns({"open": open_, "spot": spot})
    rest = words.where(~often).drop("count")
    joined = marked.join(rest, (F.col("spot") == F.col("term")) & F.col("open"), "left")
    both = {"slot": F.coalesce("common_slot", "slot"), "term": F.coalesce("common_term", "term")}
    return joined.withColumns(both).drop("common_term", "common_slot", "open", "spot")


def _sha_numbers(digest: Column) -> list[Column]:
    """A hexadecimal SHA-256 as four numbers, which hash aggregates can hold."""
    return [F.conv(F.substring(digest, 16 * k + 1, 16), 16, -10).cast("long").alias(f"sha{k}") for k in range(4)]


def _sha_text() -> Column:
    return F.concat(*(F.lower(F.lpad(F.hex(f"sha{k}"), 16, "0")) for k in range(4)))


def _by_slot(edit: int) -> Column:
    """Slot to part, of the column found (edit, slot, part)."""
    return F.map_from_entries(F.transform(F.filter("found", lambda x: x["edit"] == edit), lambda x: F.struct(x["slot"], x["part"])))


def _parts(held: str, whole: str) -> Column:
    """The fingerprint's parts from a map by slot: one a subset, or one of all terms where no subset holds any."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda j: F.coalesce(F.try_element_at(F.col(held), j), F.lit(EMPTY)))
    return F.when(F.size(held) > 0, parts).otherwise(F.array(F.lower(F.hex(whole))))


def _agreement(a: Column, b: Column) -> Column:
    """For each subset: whether two fingerprints agree, null where neither holds a term."""
    return F.zip_with(a, b, lambda x, y: F.when((x == EMPTY) & (y == EMPTY), F.lit(None)).otherwise((x == y).cast("double")))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """0 to 1 from the parts of two fingerprints and their ``_agreement``: the best share at any level."""
    count = lambda s, x: F.struct((s["n"] + F.when(x.isNotNull(), 1).otherwise(0)).alias("n"), (s["hits"] + F.coalesce(x, F.lit(0.0))).alias("hits"))
    share = lambda s: F.when(s["n"] >= 4, s["hits"] / s["n"])
    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("hits"))
    shares = [F.aggregate(F.slice(same, k * EACH + 1, EACH), start, count, share) for k in range(len(LEVELS))]
    best = F.coalesce(F.greatest(*shares), F.lit(0.0))
    return F.when(a == b, F.lit(1.0)).when((F.size(a) < SUBSETS) | (F.size(b) < SUBSETS) | b.isNull(), F.lit(0.0)).otherwise(best)


def _buckets(doc_id: Column, bounds: list, side: int) -> Column:
    """The number of bounds at or below an id, by two short searches; null ids come after all."""
    # as SQL text: one call, where a literal each would be thousands
    values = lambda some: f"array({', '.join(f'{int(b)}L' for b in some)})"
    coarse = F.expr(values(bounds[side - 1 :: side]))
    fine = F.expr(f"array({', '.join(values(bounds[c * side : c * side + side - 1]) for c in range(side))})")
    below = lambda values: F.size(F.filter(values, lambda b: b <= doc_id))
    at = below(coarse)
    return F.when(doc_id.isNull(), F.lit(side * side)).otherwise(at * side + below(F.element_at(fine, at + 1)))


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of each row of ``docs`` (doc_id, text), of its edited text, and their likenesses.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited
    text ends with the first quarter's worth of characters of the next document by doc_id (the first one after the
    last) in place of its own last quarter. Null texts are empty; empty texts share a fingerprint; texts without
    terms of the lexicon have a fingerprint of all their terms. Ties of doc_id are ordered by text; null ids come
    last. doc_id is an integer column; other columns are not read; an empty table gives none.

    One shuffle moves the texts, by ranges of doc_id; each range also gets the first document of the following one,
    so that the next document is always near, and all further steps keep that partitioning.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    count = docs.count()
    side = min(256, max(46, int((count / 500) ** 0.5)))
    steps = [(i + 1) / (side * side) for i in range(side * side - 1)]
    bounds = docs.agg(F.percentile_approx("doc_id", steps, max(10_000, 4 * side * side)).alias("b")).first()["b"]
    bounds = list(bounds) if bounds else [0] * len(steps)
    words = scratch.keep(lexicon(docs, count, low, high), "lexicon")

    placed = docs.withColumn("bucket", _buckets(F.col("doc_id"), bounds, side))
    order = Window.orderBy("bucket")
    first = placed.groupBy("bucket").agg(F.min("doc_id").alias("first_id"))  # at most side * side + 1 rows
    everything = Window.partitionBy(F.lit(0))
    first = first.select(F.col("bucket").alias("of"), "first_id", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(everything)).alias("above"))
    first = first.select("of", "first_id", "above")
    placed = placed.join(F.broadcast(first), (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
    spots = F.when(F.col("of").isNull(), F.array(F.struct(F.col("bucket").alias("at"), F.lit(0).alias("guest"))))
    spots = spots.otherwise(F.array(F.struct(F.col("bucket").alias("at"), F.lit(0).alias("guest")), F.struct(F.col("above").alias("at"), F.lit(1).alias("guest"))))
    placed = placed.select("doc_id", "text", F.explode(spots).alias("spot")).select(F.col("spot.at").alias("bucket"), F.col("spot.guest").alias("guest"), "doc_id", "text")

    row = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_last(), "text")
    rows = placed.withColumn("next", F.lead("text").over(row)).withColumn("place", F.row_number().over(row))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut))
    rows = rows.select("bucket", "place", "guest", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    rows = rows.select("bucket", "place", "guest", "doc_id", "n_chars", F.sha2("edited", 256).alias("sha"), terms(F.col("text")).alias("own"), terms(F.col("edited")).alias("new"))
    rows = rows.select("bucket", "place", "guest", "doc_id", "n_chars", *_sha_numbers(F.col("sha")), "own", "new", F.xxhash64("own").alias("own_all"), F.xxhash64("new").alias("new_all"))

    both = F.concat(F.transform("own", lambda t: F.struct(t.alias("term"), F.lit(0).alias("edit"))), F.transform("new", lambda t: F.struct(t.alias("term"), F.lit(1).alias("edit"))))
    payload = ["guest", "doc_id", "n_chars", "sha0", "sha1", "sha2", "sha3", "own_all", "new_all"]
    flat = rows.select("bucket", "place", *payload, F.posexplode_outer(both).alias("pos", "hit"))
    once = [F.when(F.coalesce("pos", F.lit(0)) == 0, F.col(c)).alias(c) for c in payload]
    flat = flat.select("bucket", "place", *once, F.coalesce("pos", F.lit(0)).alias("pos"), F.col("hit.term").alias("hit_term"), F.col("hit.edit").alias("edit"))
    flat = _with_slots(flat, words, count).where("slot IS NOT NULL OR pos = 0")
    hashed = [F.bit_xor(F.xxhash64("term", F.lit(k))).alias(f"x{k}") for k in (101, 102)]
    made = flat.groupBy("bucket", "place", "edit", "slot").agg(*(F.max(c).alias(c) for c in payload), *hashed)
    part = F.lower(F.lpad(F.hex(F.xxhash64("x101", "x102")), 16, "0"))
    made = made.groupBy("bucket", "place").agg(*(F.max(c).alias(c) for c in payload), F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("edit", "slot", part.alias("part")))).alias("found"))
    made = made.withColumns({"own_map": _by_slot(0), "new_map": _by_slot(1)})
    made = made.select("bucket", "place", "guest", "doc_id", "n_chars", _sha_text().alias("edited_sha256"), _parts("own_map", "own_all").alias("own"), _parts("new_map", "new_all").alias("new"))
    made = made.withColumn("after", F.lead("own").over(Window.partitionBy("bucket").orderBy("place"))).where("guest = 0")
    made = made.withColumns({"same": _agreement(F.col("own"), F.col("new")), "same_next": _agreement(F.col("own"), F.col("after"))})
    return made.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.concat_ws(".", "own").alias("fingerprint"),
        F.concat_ws(".", "new").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("new"), F.col("same")).alias("near_edited"),
        F.coalesce(likeness(F.col("own"), F.col("after"), F.col("same_next")), F.lit(0.0)).alias("near_next"),
    )
