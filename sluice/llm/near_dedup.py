"""MinHash near-dedup by an LSH forest.

Texts become sets of distinct five-word shingles; equal sets are one class. Each class representative gets a
MinHash signature, cut into TREES labels of DEPTH values. In each tree the labels are an order: a region is a run
that shares a prefix, as short as keeps the region within REGION members, longer where many share it (adaptive
depth). Candidates are neighbours in the order within a region, and the region's first member where even the whole
label is shared by more. Candidates whose signatures agree enough are confirmed on the full sets; links of
confirmed pairs give components. A second round does the same for neighbours that ended in different components.
What shares BAND values of a label and is still apart goes on to an exact prefix filter on the full sets: no family is
too large for its links to be found, and texts that only look alike cost no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.llm import batches as batch_rows
from sluice.llm import shingles
from sluice.llm.components import connected
from sluice.operators.patterns import looked_up
from sluice.plans import scratch

TREES, DEPTH, REGION, NEIGHBOURS = 24, 4, 64, 3
#: Pairs of a likeness of 0.75 share no BAND values of any label with a chance of about 2e-6.
BAND = 3
#: Rounds in which neighbours among what shares a rare shingle are joined, before all pairs that are left are made.
ROUNDS, BESIDE = 2, 12
#: Rows of a shingle that are joined in one task.
CHUNK = 1024
#: Signatures of 96 values at a likeness of 0.75 agree on less than half with a chance of about 1e-7.
SURE = 0.5
#: Bits of the filter that keeps full sets of unpaired documents out of the confirming joins.
FILTER = 1 << 26
#: Dropped ids up to so many are broadcast, at about 16 bytes each.
FEW = 1_000_000


def _signer():
    draw = np.random.default_rng(20_241)
    a, b = (draw.integers(0, 1 << 32, TREES * DEPTH, np.uint32) | np.uint32(1) for _ in "ab")

    def signatures(sets: list[np.ndarray]) -> np.ndarray:
        full = [i for i, s in enumerate(sets) if len(s)]
        out = np.zeros((len(sets), TREES * DEPTH), np.uint32)
        if full:
            flat = np.concatenate([sets[i] for i in full])
            low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
            at = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
            for j in range(TREES * DEPTH):
                out[full, j] = np.minimum.reduceat(low * a[j] ^ high * b[j], at)
        return out.view(np.int32)

    return signatures


@batch_rows.returning
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sign = _signer()
    for batch in batches:
        ids = batch.column(0)
        for start, end, data, offsets in shingles.blocks(batch.column(1)):
            sets = shingles.shingle_sets(data, offsets)
            keys = np.array([[len(s), int(shingles.mix(s * np.uint64(3)).sum()), int(np.bitwise_xor.reduce(shingles.mix(s + np.uint64(7))))] if len(s) else [0, 0, 0] for s in sets], np.uint64)
            sig = sign(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(start, end - start),
                    pa.array(keys[:, 0].astype(np.int64)),
                    pa.array(keys[:, 1].view(np.int64)),
                    pa.array(keys[:, 2].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, TREES * DEPTH, dtype=np.int32)), pa.array(sig.ravel())),
                ],
                ["doc_id", "n_shingles", "key1", "key2", "sig"],
            )


@batch_rows.returning
def _only(batches: Iterator[pa.RecordBatch], bits) -> Iterator[pa.RecordBatch]:
    """Full sets of the rows whose marks are all in the filter."""
    held = bits.value
    for batch in batches:
        keep = np.ones(len(batch), bool)
        for i in range(2, batch.num_columns):
            at = batch.column(i).to_numpy()
            keep &= (held[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        part = batch.filter(pa.array(keep))
        for start, end, data, offsets in shingles.blocks(part.column(1)):
            sets = shingles.shingle_sets(data, offsets)
            at = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            flat = np.concatenate(sets) if at[-1] else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0).slice(start, end - start), pa.ListArray.from_arrays(pa.array(at), pa.array(flat.view(np.int64)))], ["node", "shingles"])


def _sets_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, shingles) of the documents in ``pairs``, and of a few others.

    A Bloom filter of the ids, of FILTER bits at most (so its broadcast is bounded; beyond about a tenth as many
    ids it lets more others pass, which costs time and changes nothing), keeps the rest of the texts from being
    shingled and shuffled.
    """
    spark = docs.sparkSession
    ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    bits = min(FILTER, max(1 << 16, 1 << (16 * ids.count()).bit_length()))
    marks = lambda c: [F.pmod(F.xxhash64(c, F.lit(k)), F.lit(bits)) for k in range(3)]
    spots = ids.select(F.explode(F.array(*marks("node"))).alias("at"))
    words = spots.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63L as int))")).alias("mask")).toArrow()
    held = np.zeros(bits >> 6, np.uint64)
    held[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", *marks("doc_id")).mapInArrow(partial(_only, bits=spark.sparkContext.broadcast(held)), f"node {kind}, shingles array<long>")


def _regions(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of regions (tree, region, node, label) and pairs (a, b) with the first of those that share a label.

    Nodes that share no prefix have no row. Each depth is written once: what it leaves is read by the next."""
    depth = [F.col(f"h{d}") for d in range(1, DEPTH + 1)]
    parts, rest = [], labels.withColumn("above", F.lit(1))
    for d in range(1, DEPTH + 1):
        prefix = ["tree", *(f"h{i}" for i in range(1, d + 1))]
        count = rest.groupBy(*prefix).agg(F.count("*").alias("members"))
        if d == 1:
            count = count.where("members > 1")
        rest = scratch.keep(looked_up(rest, scratch.keep(count, "prefixes"), prefix, size="members"), "regions")
        # alone at this depth, but in a large region above: the neighbours there, in chunks
        region = F.when(F.col("members") == 1, F.xxhash64(*prefix[:-1], F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("above") / REGION)), F.lit(-d)))
        region = region.otherwise(F.xxhash64(*prefix, F.lit(d)))
        parts.append(rest.where(F.col("members") <= REGION).select("tree", region.alias("region"), "node", *depth))
        rest = rest.where(F.col("members") > REGION).drop("above").withColumnRenamed("members", "above")
    chunk = F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("above") / REGION))
    parts.append(rest.select("tree", F.xxhash64("tree", *depth, chunk, F.lit(0)).alias("region"), "node", *depth))
    whole = scratch.keep(rest.groupBy("tree", *depth).agg(F.min("node").alias("head"), F.count("*").alias("size")), "heads")
    stars = looked_up(rest, whole, ["tree", *(f"h{i}" for i in range(1, DEPTH + 1))], size="size").select(F.col("head").alias("a"), F.col("node").alias("b"))
    return reduce(DataFrame.unionByName, parts), scratch.keep(stars, "stars")


def _pairs(members: DataFrame, apart: DataFrame | None = None) -> DataFrame:
    """Neighbours in the order of each region; with ``apart`` (node, component) the nearest of another component."""
    order = Window.partitionBy("tree", "region").orderBy(*(f"h{i}" for i in range(1, DEPTH + 1)), "node")
    if apart is None:
        near = members.select("node", F.array(*(F.lag("node", k).over(order) for k in range(1, NEIGHBOURS + 1))).alias("near"))
        pairs = near.select(F.col("node").alias("b"), F.explode("near").alias("a")).where("a IS NOT NULL")
    else:
        own = F.coalesce("component", "node")
        runs = members.join(apart, "node", "left").withColumn("own", own).withColumn("before", F.lag("node").over(order)).withColumn("other", F.lag("own").over(order) != F.col("own"))
        start = F.last(F.when(F.col("other"), F.col("before")), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
        turned = runs.withColumn("a", start).withColumn("after", F.when(F.lead("own").over(order) != F.col("own"), F.lead("node").over(order)))
        ahead = F.first("after", True).over(order.rowsBetween(0, Window.unboundedFollowing))
        pairs = turned.withColumn("c", ahead).select(F.col("node").alias("b"), F.explode(F.array("a", "c")).alias("a")).where("a IS NOT NULL")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")


def likely(pairs: DataFrame, table: DataFrame, sure: float = SURE) -> DataFrame:
    """(a, b, agree): distinct pairs whose sizes and signatures allow a link, of nodes in ``table`` (doc_id, sig, n_shingles).

    Signatures allow it if they agree on a share ``sure`` of their values.
    """
    sig = table.select(F.col("doc_id").alias("node"), "sig", "n_shingles")
    named = lambda x: sig.select(*(F.col(c).alias(c if c == "node" else f"{c}_{x}") for c in sig.columns)).withColumnRenamed("node", x)
    wide = pairs.distinct().join(named("b"), "b").join(named("a"), "a")
    wide = wide.where("4 * least(n_shingles_a, n_shingles_b) >= 3 * greatest(n_shingles_a, n_shingles_b)")
    agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return wide.where(agree >= F.floor(F.size("sig_a") * F.lit(sure))).select("a", "b", agree.alias("agree"))


def confirmed(pairs: DataFrame, sets_of) -> DataFrame:
    """Pairs with 100 * intersection >= 75 * union of the full sets; ``sets_of`` gives (node, shingles) of pairs."""
    sets = sets_of(pairs)
    wide = pairs.join(sets.withColumnsRenamed({"node": "b", "shingles": "set_b"}), "b").join(sets.withColumnsRenamed({"node": "a", "shingles": "set_a"}), "a")
    both = F.size(F.array_intersect("set_a", "set_b"))
    return wide.select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b") - both).alias("all")).where("100 * both >= 75 * all").select("a", "b")


def held_apart(bands: DataFrame, groups: DataFrame) -> DataFrame:
    """(band, node, own, members) of bands whose nodes are in more than one component (own)."""
    held = scratch.keep(bands.join(groups, "node", "left").select("band", "node", F.coalesce("component", "node").alias("own")), "held")
    split = held.groupBy("band").agg(F.count("*").alias("members"), F.min("own").alias("least"), F.max("own").alias("last"))
    return scratch.keep(looked_up(held, scratch.keep(split, "split"), ["band"], size="members").where("least <> last").drop("least", "last"), "apart")


def _front(held: DataFrame, sets_of) -> DataFrame:
    """(token, node, own, n, place, members): the rarest shingles of the nodes of ``held`` that several components share.

    Sets are ordered by how rare their shingles are among these nodes. A pair that links shares 6 / 7 of the smaller
    set and 3 / 4 of the larger at least, so one of the first n // 7 + 1 shingles of the smaller is among the first
    n // 4 + 1 of the larger.
    """
    nodes = scratch.keep(held.select("node", "own").distinct(), "nodes")
    sets = sets_of(nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))).join(nodes, "node")
    tokens = scratch.keep(sets.select("node", "own", F.size("shingles").alias("n"), F.explode("shingles").alias("token")), "tokens")
    counts = scratch.keep(tokens.groupBy("token").agg(F.count("*").alias("held")), "counts")
    placed = looked_up(tokens, counts, ["token"], size="held")
    place = F.row_number().over(Window.partitionBy("node").orderBy("held", "token"))
    front = scratch.keep(placed.withColumn("place", place).where("held > 1 AND place <= n DIV 4 + 1").select("token", "node", "own", "n", "place"), "front")
    scratch.release(tokens, counts)
    return _split(front)


def _split(front: DataFrame) -> DataFrame:
    """The rows of ``front`` whose shingle is held by nodes of several components, with their number (members)."""
    split = front.groupBy("token").agg(F.count("*").alias("members"), F.min("own").alias("least"), F.max("own").alias("last"))
    return scratch.keep(looked_up(front, scratch.keep(split, "split"), ["token"], size="members").where("least <> last").drop("least", "last"), "front")


def _may(x: dict[str, Column], y: dict[str, Column]) -> Column:
    """Whether sizes and the place of a first shared shingle allow a link of nodes that are apart.

    At that shingle, no more can follow than the shorter rest of the two. Texts that share a common part but differ by
    more than the threshold allows have shingles of their own in front, so that whole families of them make no pairs.
    """
    alike = 4 * F.least(x["n"], y["n"]) >= 3 * F.greatest(x["n"], y["n"])
    return (x["own"] != y["own"]) & alike & (7 * (1 + F.least(x["n"] - x["place"], y["n"] - y["place"])) >= 3 * (x["n"] + y["n"]))


def _beside(front: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) that may link of neighbours in a random order of a shingle's nodes: BESIDE a row at most."""
    fields = ("node", "own", "n", "place")
    chunk = F.pmod(F.xxhash64("node", F.lit(turn)), F.ceil(F.col("members") / CHUNK))
    order = Window.partitionBy("token", chunk).orderBy(F.xxhash64("node", "token", F.lit(turn)), "node")
    row = {c: F.col(c) for c in fields}
    near = front.where("place <= n DIV 7 + 1").withColumn("near", F.array(*(F.lag(F.struct(*fields), k).over(order) for k in range(1, BESIDE + 1))))
    near = near.select("node", F.explode(F.filter("near", lambda o: _may(row, {c: o[c] for c in fields}))).alias("other"))
    return near.select(F.least("node", "other.node").alias("a"), F.greatest("node", "other.node").alias("b"))


def _rest(front: DataFrame) -> DataFrame:
    """All pairs (a, b) of ``front`` that may link."""
    # shingles that many have in front are dealt to several tasks
    salts = F.ceil(F.col("members") / CHUNK).cast("int")
    fields = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("node", "own", "n", "place")]
    row = lambda x: {c: F.col(f"{c}_{x}") for c in ("own", "n", "place")}
    small = front.where("place <= n DIV 7 + 1").select("token", F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"), *fields("x"))
    large = front.select("token", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), *fields("y"))
    pairs = small.join(large, ["token", "salt"]).where("n_x <= n_y").where(_may(row("x"), row("y")))
    return pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))


def _merged(groups: DataFrame, found: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components (node, component) with the links ``found`` too, of nodes with their component so far (own); and what became of each own."""
    for end in "ab":
        found = found.join(nodes.select(F.col("node").alias(end), F.col("own").alias(f"own_{end}")), end)
    tops = connected(found.select(F.col("own_a").alias("a"), F.col("own_b").alias("b")))
    new = tops.select(F.col("node").alias("component"), F.col("component").alias("top"))
    named = looked_up(groups, new, ["component"], "left").select("node", F.coalesce("top", "component").alias("component"))
    return scratch.keep(named.union(tops.join(groups, "node", "left_anti")), "groups"), tops.select(F.col("node").alias("own"), F.col("component").alias("top"))


def shared(held: DataFrame) -> DataFrame:
    """The rows of ``held`` (band, node) whose band has another node, with its number of nodes (members)."""
    counts = scratch.keep(held.groupBy("band").agg(F.count("*").alias("members")).where("members > 1"), "crowded")
    return scratch.keep(looked_up(held, counts, ["band"], size="members"), "shared")


def settled(links: DataFrame, tested: DataFrame, bands: DataFrame, table: DataFrame, sets_of, sure: float = SURE) -> DataFrame:
    """Components (node, component) once no pair that shares a band is left apart without having been tested.

    ``bands`` has (band, node), ``tested`` the pairs that were already confirmed or refused, ``links`` those confirmed.
    Nodes whose bands hold several components are compared by the prefix filter: neighbours first, so that families
    whose links are few join before all pairs of different components are made.
    """
    groups = connected(links)
    held = held_apart(bands, groups)
    if held.isEmpty():
        return groups
    front = _front(held, sets_of)
    for pairs_of in (*(partial(_beside, turn=k) for k in range(ROUNDS)), _rest):
        more = likely(pairs_of(front), table, sure).select("a", "b")
        more = scratch.keep(more.join(tested, ["a", "b"], "left_anti"), "more")
        found = scratch.keep(confirmed(more, sets_of), "links")
        if found.isEmpty():
            continue
        tested = tested.union(more)
        groups, tops = _merged(groups, found, front.select("node", "own").distinct())
        front = _split(looked_up(front.drop("members"), tops, ["own"], "left").withColumn("own", F.coalesce("top", "own")).drop("top"))
    return groups


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs``.

    Links join texts whose shingle sets have 100 * intersection >= 75 * union; component_id is the smallest id
    reachable; kept marks that id. Null and empty texts, and texts without words, have no shingles and stand
    alone. Rows without an id take no part: component_id is null and kept true. Rows that share an id are one
    document (linked through any of their texts), each returned. An empty table gives an empty result; other
    columns of ``docs`` are not read.
    """
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_shingles long, key1 long, key2 long, sig array<int>"
    batch_rows.bound(docs.sparkSession)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    table = scratch.keep(docs.mapInArrow(_sets, schema), "sets")
    rows = table.select("doc_id", "n_shingles", "key1", "key2")
    classes = scratch.keep(rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("n_shingles", "key1", "key2").agg(F.min("doc_id").alias("node")), "classes")
    first = table.where("n_shingles > 0").join(classes.select(F.col("node").alias("doc_id"), "key1", "key2", "n_shingles"), ["doc_id", "n_shingles", "key1", "key2"], "left_semi")
    cut = F.array(*(F.struct(F.lit(t).alias("tree"), *(F.col("sig")[t * DEPTH + d].alias(f"h{d + 1}") for d in range(DEPTH))) for t in range(TREES)))
    labels = scratch.keep(first.select(F.col("doc_id").alias("node"), F.explode(cut).alias("cut")).select("node", "cut.*"), "labels")
    sets_of = partial(_sets_of, docs)
    members, stars = _regions(labels)
    members = scratch.keep(members, "members")
    probable = scratch.keep(likely(_pairs(members).union(stars), table), "likely")
    best = Window.partitionBy("b").orderBy(F.desc("agree"), "a")
    close = scratch.keep(probable.withColumn("place", F.row_number().over(best)).where("place <= 3").select("a", "b"), "close")
    links = scratch.keep(confirmed(close, sets_of), "links")
    groups = connected(links)
    more = _cross(probable.select("a", "b"), groups)
    more = more.union(_cross(likely(_pairs(members, groups), table).select("a", "b"), groups)).distinct()
    more = scratch.keep(more, "more")
    links = links.union(scratch.keep(confirmed(more, sets_of), "links"))
    bands = labels.select(F.xxhash64("tree", *(f"h{d}" for d in range(1, BAND + 1))).alias("band"), "node").distinct()
    groups = settled(links, close.union(more), shared(scratch.keep(bands, "bands")), table, sets_of)
    named = classes.join(groups, "node", "left").select("n_shingles", "key1", "key2", F.coalesce("component", "node").alias("component"))
    alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = rows.join(named, ["n_shingles", "key1", "key2"], "left").select("doc_id", "n_shingles", alone.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _cross(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose ends are in different components so far."""
    named = lambda x: groups.select(F.col("node").alias(x), F.col("component").alias(f"group_{x}"))
    wide = pairs.join(named("a"), "a", "left").join(named("b"), "b", "left")
    return wide.where(F.coalesce("group_a", "a") != F.coalesce("group_b", "b")).select("a", "b")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) without near duplicates: the smallest id of each group stays.

    Rows without an id stay. Texts are moved only where more than FEW ids are dropped.
    """
    dropped = scratch.keep(near_duplicates(docs).where("NOT kept").select("doc_id").distinct(), "dropped")
    dropped = F.broadcast(dropped) if dropped.count() <= FEW else dropped
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def oracle(documents: str = "documents") -> str:
    """The same rows in DuckDB SQL: all shared shingles joined, for small tables."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\x20\x09-\x0D]+') AS words FROM {documents}
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' '))
    WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingles FROM w
), e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), r AS (SELECT a AS node, b AS reached FROM p UNION SELECT r.node, p.b FROM r JOIN p ON r.reached = p.a
), c AS (SELECT node, min(reached) AS least FROM r GROUP BY node)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, least(doc_id, coalesce(c.least, doc_id)) AS component_id, doc_id <= coalesce(c.least, doc_id) AS kept
FROM s LEFT JOIN c ON node = doc_id
"""
