"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Every document draws u from a hash of its id and gets the key -ln(u) / quality: smallest keys first, which samples
without replacement in proportion to quality. A source whose target is k whole sizes and a fraction takes every
document k times, then documents in order of their keys until the fraction of its size is reached. Where that is, is
found by sums of sizes over ranges of keys, which are narrowed until the range in question holds few documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm.batches import free
from sluice.plans import scratch

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
#: Key ranges a source is cut into in each round, and the documents of a range that are put in order at once.
RANGES, FEW = 4096, 2000
#: Tables of more sources are joined by a shuffle.
BROADCAST_SOURCES = 100_000

WORD, SPACE = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"
SYMBOL = r"[!#$%&*+/<=>?@\[\]^_{|}~0-9]"


def size(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """A weight from 0.05 to 1 of a text; pass another column where there is a better one, such as a model's score.

    It is a product: how few of the characters are symbols and digits; how many different words there are for the
    square root of all words (repetitive texts have few); and half for words that are shorter than 2 or longer than
    12 characters on average. Null and empty texts weigh 0.05.
    """
    words = F.array_remove(F.split(text, SPACE + "+"), "")
    number = F.greatest(F.size(words), F.lit(1)).cast("double")
    symbols = F.regexp_count(text, F.lit(SYMBOL)).cast("double") / F.greatest(F.length(text), F.lit(1)).cast("double")
    variety = F.size(F.array_distinct(words)).cast("double") / F.sqrt(number)
    length = (F.length(text) - F.regexp_count(text, F.lit(SPACE))).cast("double") / number
    whole = (F.lit(1.0) - F.lit(8.0) * symbols) * F.least(F.lit(1.0), variety / F.lit(4.0)) * F.when((length >= 2.0) & (length <= 12.0), F.lit(1.0)).otherwise(F.lit(0.5))
    return F.coalesce(F.greatest(F.lit(0.05), whole), F.lit(0.05))


def draw(doc_id: Column, text: Column, seed: str) -> Column:
    """A number between 0 and 1 from the digits of md5 over the seed and the id; rows without one go by their text."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null"), F.md5(F.coalesce(text, F.lit("")))))
    digits = F.substring(F.md5(F.concat(F.lit(seed), name)), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**12))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Weights repeat over the sources in code-point order, null last; they share ``share`` of all sizes. No target
    exceeds ``most`` times its source's size: with sources by size over weight, the level that the rest shares is
    the smallest one at which the sources after a prefix stay below their limits, so one pass of running sums over
    the sources (not the documents) finds it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = reduce(lambda c, k: c.when(place == k, F.lit(weights[k])), range(1, len(weights)), F.when(place == 0, F.lit(weights[0])))
    rows = sources.withColumn("weight", weight).withColumn("limit", F.lit(most) * F.col("source_size").cast("double"))
    everything = Window.partitionBy(F.lit(0))
    rising = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.lit(share) * F.sum("source_size").over(everything).cast("double"))
    rows = rows.withColumn("full", F.coalesce(F.sum("limit").over(rising), F.lit(0.0)))
    rows = rows.withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0)))
    level = (F.col("total") - F.col("full")) / F.col("open")
    fits = level * F.col("weight") <= F.col("limit")
    rows = rows.withColumn("level", F.min_by(F.when(fits, level), F.when(fits, F.col("limit") / F.col("weight"))).over(everything))
    target = F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return rows.select("source", "source_size", target.alias("target"))


def drawn(seed: str = "mix-", weight: Column | None = None) -> Column:
    """What the mix knows of a document (doc_id, text), as one struct: key, doc_id, size and a tie-break, in order."""
    text = F.col("text")
    key = -F.ln(draw(F.col("doc_id"), text, seed)) / (quality(text) if weight is None else weight)
    return F.struct(key.alias("key"), F.col("doc_id").alias("doc_id"), size(text).alias("size"), F.xxhash64(text).alias("tie"))


def _spread(key: Column) -> Column:
    """A key from 0 to infinity as a number from 0 to 1, in the same order."""
    return key / (key + F.lit(1.0))


def _narrowed(rows: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The key range (low, high) of each source in which its budget ends, with the sum below it (base) and its rows (n).

    Also the rows of these ranges. Each round cuts a source's range into RANGES and keeps one; sums are aggregated over
    (source, range), so no task holds a source's documents.
    """
    at = _spread(F.col("place.key"))
    ends = wanted.select("of", "part", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), F.lit(0).cast("long").alias("base"))
    most = None
    while True:
        step = (F.col("high") - F.col("low")) / F.lit(float(RANGES))
        inside = rows.join(small(ends), F.col("source").eqNullSafe(F.col("of")) & (at >= F.col("low")) & (at < F.col("high")))
        ranged = inside.withColumn("range", F.least(F.floor((at - F.col("low")) / step), F.lit(RANGES - 1)))
        held = ranged.groupBy("of", "part", "low", "high", "base", "range").agg(F.sum("place.size").alias("held"), F.count("*").alias("n"), F.min(at).alias("least"), F.max(at).alias("last"))
        before = Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        held = held.withColumn("base", F.col("base") + F.coalesce(F.sum("held").over(before), F.lit(0)))
        last = held.where("base <= part AND part < base + held")
        # bounds that real keys have: a range of one key cannot be narrowed
        last = last.withColumn("first", F.row_number().over(Window.partitionBy("of").orderBy("range"))).where("first = 1")
        ends = scratch.keep(last.select("of", "part", F.col("least").alias("low"), (F.col("last") + F.lit(1e-15) * F.greatest(F.col("last"), F.lit(1e-3))).alias("high"), "base", "n", (F.col("last") > F.col("least")).alias("open")), "ends")
        found = ends.where("open").agg(F.max("n")).first()[0] or 0
        if found <= FEW or found == most:
            return ends, rows.join(small(ends.drop("part")), F.col("source").eqNullSafe(F.col("of")) & (at >= F.col("low")) & (at < F.col("high")))
        most = found
        ends = ends.select("of", "part", "low", "high", "base")


def cuts(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row a source (of): its size, target, whole epochs, and after which place in key order its sampling ends.

    ``rows`` has source and place (see ``drawn``). A null end takes all of a source, or nothing (whole tells).
    """
    sources = rows.groupBy("source").agg(F.sum("place.size").alias("source_size"))
    marked = targets(sources, weights, share, most)
    epochs = F.floor(F.col("target") / F.greatest("source_size", F.lit(1)).cast("double"))
    part = F.col("target") - epochs.cast("double") * F.col("source_size").cast("double")
    wanted = scratch.keep(marked.select(F.col("source").alias("of"), "source_size", "target", epochs.alias("epochs"), part.alias("part")), "wanted")
    ends, inside = _narrowed(rows, wanted)
    # rows that are equal in all that the order knows are taken together
    ties = inside.groupBy("of", "base", "place").agg(F.sum("place.size").alias("held"))
    order = Window.partitionBy("of").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = (F.col("base") + F.sum("held").over(order)).cast("double")
    parts = wanted.select(F.col("of").alias("whose"), "part")
    fits = ties.withColumn("upto", upto).join(small(parts), F.col("of").eqNullSafe(F.col("whose"))).where(F.col("upto") - F.col("held").cast("double") / 2 <= F.col("part"))
    # without a place that fits, all before the range is taken
    ended = ends.select(F.col("of").alias("ending"), "low")
    last = fits.groupBy(F.col("of").alias("whose")).agg(F.max("place").alias("end"))
    out = wanted.join(ended, F.col("of").eqNullSafe(F.col("ending")), "left").join(last, F.col("of").eqNullSafe(F.col("whose")), "left")
    return scratch.keep(out.select("of", "source_size", "target", "epochs", "low", "end", (F.col("part") >= F.col("source_size")).alias("whole")), "cuts")


def small(table: DataFrame) -> DataFrame:
    """A table of one row a source, for a broadcast if it is below BROADCAST_SOURCES rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table


def copies(place: Column, cut: Column, most: float = MOST) -> Column:
    """How often the mix takes a document, from its place and its source's row of ``cuts``."""
    below = F.when(cut["end"].isNotNull(), place <= cut["end"]).when(cut["low"].isNotNull(), _spread(place["key"]) < cut["low"]).otherwise(cut["whole"])
    return (cut["epochs"] + F.when(below & (cut["epochs"] < F.lit(most)), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, seed: str = "mix-", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, weight: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row of ``docs`` (doc_id, text, source).

    taken counts the words the mix takes of a document, repeats included: whole epochs times its size, and its
    size once more if it is sampled, which it is if more than half of it lies below the budget in key order. Null
    and empty texts have size 0 and are taken with 0 words; a null source is a source of its own; rows without an id
    draw by their text; equal keys are ordered by id, size and text hash, so reruns agree, and rows equal in all of
    these are taken together. An empty table gives none. ``weight`` is a column of positive numbers that replaces
    ``quality``; other columns are not read.
    """
    rows = scratch.keep(docs.select("source", drawn(seed, weight).alias("place")), "drawn")
    ends = cuts(rows, weights, share, most)
    full = rows.join(small(ends.select(F.struct("*").alias("cut"))), F.col("source").eqNullSafe(F.col("cut.of")))
    taken = full.select("place", "cut", copies(F.col("place"), F.col("cut"), most).alias("copies"))
    return taken.select("place.doc_id", "place.size", "cut.source_size", "cut.target", (F.col("copies") * F.col("place.size")).cast("long").alias("taken"), "copies")


def mixed(docs: DataFrame, seed: str = "mix-", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, weight: Column | None = None) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with all their columns; texts are not shuffled.

    Edge cases are those of ``mix``; columns of any other name pass unchanged.
    """
    names = docs.columns
    thin = scratch.keep(docs.select("source", drawn(seed, weight).alias("place")), "drawn")
    place, cut, copy = (free(names, x) for x in ("place", "cut", "copy"))
    ends = small(cuts(thin, weights, share, most).select(F.struct("*").alias(cut)))
    full = docs.withColumn(place, drawn(seed, weight)).join(ends, F.col("source").eqNullSafe(F.col(f"{cut}.of")))
    every = F.explode(F.array_repeat(F.lit(0), copies(F.col(place), F.col(cut), most)))
    return full.select(*(F.col(f"`{n}`") for n in names), every.alias(copy)).drop(copy)


#: The same for DuckDB, over a table of documents with the columns doc_id, text and source.
def oracle(documents: str = "documents") -> str:
    return rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(words) AS BIGINT) AS size, sha256(text) AS tie,
    coalesce(greatest(0.05::DOUBLE, (1.0::DOUBLE - 8.0::DOUBLE * ((length(text) - length(regexp_replace(text, '{SYMBOL}', '', 'g')))::DOUBLE / greatest(length(text), 1)::DOUBLE))
      * least(1.0::DOUBLE, len(list_distinct(words))::DOUBLE / sqrt(greatest(len(words), 1)::DOUBLE) / 4.0::DOUBLE)
      * CASE WHEN length(regexp_replace(text, '{SPACE}', '', 'g'))::DOUBLE / greatest(len(words), 1)::DOUBLE BETWEEN 2 AND 12 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END), 0.05::DOUBLE) AS quality,
    (('0x' || left(md5('mix-' || coalesce(CAST(doc_id AS VARCHAR), 'null' || md5(coalesce(text, '')))), 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / {float(16**12)}::DOUBLE AS u
  FROM (SELECT *, coalesce(regexp_extract_all(text, '{WORD}'), []) AS words FROM {documents})
), k AS (SELECT *, -ln(u) / quality AS key FROM d
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    2.0::DOUBLE * source_size::DOUBLE AS lim, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total
  FROM s
), r AS (
  SELECT *, coalesce(sum(lim) OVER o, 0) AS filled, (sum(weight) OVER ()) - coalesce(sum(weight) OVER o, 0) AS unfilled
  FROM w WINDOW o AS (ORDER BY lim / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (SELECT arg_min((total - filled) / unfilled, lim / weight) FROM r AS x WHERE (x.total - x.filled) / x.unfilled * x.weight <= x.lim) AS level FROM r
), t AS (
  SELECT source, source_size, least(lim, coalesce(level * weight, lim)) AS target FROM l
), e AS (
  SELECT *, floor(target / greatest(source_size, 1)::DOUBLE) AS epochs FROM t
), f AS (
  SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size::DOUBLE AS part,
    (sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size, k.tie ROWS UNBOUNDED PRECEDING))::DOUBLE AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + CASE WHEN upto - size::DOUBLE / 2 <= part AND epochs < 2 THEN size ELSE 0 END AS BIGINT) AS taken,
  CAST(epochs + CASE WHEN upto - size::DOUBLE / 2 <= part AND epochs < 2 THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM f
"""
