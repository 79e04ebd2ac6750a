"""The registered queries over the star-schema tables, and their DuckDB equivalents."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sluice.functions import keys, values
from sluice.operators import patterns, shuffle, stats
from sluice.plans import job, scratch
from sluice.plans.spec import JobSpec, Pipe
from sluice.sources import readers, sorted_kv, writers
from sluice.streaming import pipes

#: Bytes of a file that is read as one range.
RANGE = 4 << 20

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# DuckDB forms of the key functions
def _hash_sql(s: str) -> str:
    return f"""CASE WHEN {s} = '' THEN 0 ELSE list_reduce(list_prepend(1::BIGINT, list_transform(range(0, octet_length(encode({s}))),
      lambda i: ('0x' || substr(hex(encode({s})), 2*i+1, 2))::BIGINT)),
      lambda h, b: ((31*h + CASE WHEN b > 127 THEN b-256 ELSE b END) % 2147483648 + 2147483648) % 2147483648) END"""


def _fields_sql(line: str, n: int, chars: str) -> str:
    k = f"regexp_extract({line}, '^([^{chars}]*(?:[{chars}][^{chars}]*){{0,{n - 1}}})', 1)"
    return f"CASE WHEN length({k}) = length({line}) AND regexp_matches({line}, '[{chars}]$') THEN left({line}, length({line}) - 1) ELSE {k} END"


# sources, sinks and line filters


@query("SELECT word, count(*)::BIGINT AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '[ \\n]+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def wordcount(spark, d):
    return patterns.word_count(table(spark, d, "documents"))


@query("SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> ''")
def text_scan_lines(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("value"))
    return shuffle.without_empty(lines).withColumnRenamed("value", "line")


@query("SELECT line, count(*)::BIGINT AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY line")
def text_file_round_trip(spark, d):
    at = scratch.path(spark, "lines")
    writers.text(table(spark, d, "documents").select(F.col("text").alias("value")), at, gzip=True)
    return readers.text(spark, at).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query("SELECT CAST(event_id AS VARCHAR) AS key, event_type AS value FROM events")
def sequence_file_round_trip(spark, d):
    at = scratch.path(spark, "sequence")
    writers.sequence_file(table(spark, d, "events").select(F.col("event_id").cast("string").alias("key"), F.col("event_type").alias("value")), at)
    return readers.sequence_file(spark, at).select(F.col("key").cast("string"), F.col("value").cast("string"))


def _written(spark, lines, name="lines"):
    at = scratch.path(spark, name)
    writers.text(lines, at)
    return at


@query("SELECT s_name AS value FROM supplier")
def local_text_scan(spark, d):
    return readers.local_text(spark, _written(spark, table(spark, d, "supplier").select("s_name")))


@query("SELECT '0' AS key, c_name AS value FROM customer")
def text_as_pairs(spark, d):
    """Files below the split size: each range starts at 0."""
    at = scratch.path(spark, "lines")
    writers.text(table(spark, d, "customer").select("c_name"), at, most=RANGE)
    return readers.text_pairs(readers.with_split_size(spark, RANGE, least=RANGE), at)


@query("SELECT count(*)::BIGINT AS n, sum(o_orderkey)::BIGINT AS keys, true AS many, true AS own FROM orders")
def split_ranges(spark, d):
    """Ranges of 4 KB hold every line once, and the caller's session keeps its own size."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    at = _written(spark, table(spark, d, "orders").coalesce(1).select(F.col("o_orderkey").cast("string")))
    ranges = readers.files_of(readers.with_split_size(spark, 4096), at)
    starts = F.count_distinct("start") >= F.floor(F.sum(F.length("value") + 1) / 4096)
    return ranges.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("long")).alias("keys"), starts.alias("many")).withColumn("own", F.lit(spark.conf.get(name) == before))


@query("SELECT n_name AS value FROM nation WHERE n_regionkey IN (0, 2) UNION ALL SELECT n_name FROM nation WHERE n_regionkey = 4")
def paths_of_inputs(spark, d):
    """Braces, a folder and a star; hidden files are not read."""
    at = scratch.path(spark, "regions")
    for k in range(5):
        writers.text(table(spark, d, "nation").where(F.col("n_regionkey") == k).select("n_name"), f"{at}/r{k}")
        writers.text(table(spark, d, "region").select("r_name"), f"{at}/_r{k}")
    return readers.text(spark, [f"{at}/r{{0,2}}", f"{at}/?4/part-*"])


@query("SELECT 'binary' AS format, count(*)::BIGINT AS n FROM supplier UNION ALL SELECT 'sequence', count(*)::BIGINT FROM supplier UNION ALL SELECT 'suffix', count(*)::BIGINT FROM supplier UNION ALL SELECT 'text', count(*)::BIGINT FROM supplier")
def output_formats(spark, d):
    lines, parts = table(spark, d, "supplier").select(F.concat("s_name", F.lit("#A")).alias("value")), []
    for name in ("TextOutputFormat", "SuffixMultipleTextOutputFormat", "SequenceFileAsBinaryOutputFormat", "BinaryOutputFormat"):
        kind, at = writers.OutputFormat.named(name), scratch.path(spark, "out")
        writers.write(lines, kind, at, gzip=name.startswith("Text"))
        back = readers.text(spark, at) if "Text" in name else readers.sequence_file(spark, at)
        parts.append(back.agg(F.count("*").alias("n")).select(F.lit(kind.name.lower()).alias("format"), "n"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("SELECT 'refused' AS second, count(*)::BIGINT AS n FROM region")
def output_must_be_new(spark, d):
    lines = table(spark, d, "region").select("r_name")
    at = _written(spark, lines)
    try:
        writers.text(lines, at)
        second = "written"
    except Exception as e:  # noqa: BLE001
        second = "refused" if "exists" in str(e) else str(e)
    return readers.text(spark, at).groupBy(F.lit(second).alias("second")).agg(F.count("*").alias("n"))


@query("SELECT '0' || chr(9) || r_name AS value FROM region")
def nline_index(spark, d):
    at = scratch.path(spark, "nline")
    writers.text(table(spark, d, "region").select(F.col("r_name").alias("value")), at)
    return readers.nline(spark, at)


@query("SELECT o_orderstatus AS suffix, CAST(o_orderkey AS VARCHAR) AS value FROM orders")
def suffix_multi_output(spark, d):
    at = scratch.path(spark, "suffix")
    lines = table(spark, d, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit("#"), "o_orderstatus").alias("value"))
    writers.suffix_files(lines.union(lines.limit(1).select(F.lit("no suffix#a"))), at)
    return spark.read.text(at).select("suffix", "value")


@query("SELECT event_type AS tag, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def side_outputs(spark, d):
    at = scratch.path(spark, "side")
    writers.side_outputs(table(spark, d, "events").select(F.col("event_type").alias("tag"), F.col("event_id").cast("string").alias("value")), at)
    return spark.read.text(at).groupBy("tag").agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS large FROM documents WHERE octet_length(encode(text)) > 20000")
def large_records(spark, d):
    return shuffle.without_large(table(spark, d, "documents").select(F.col("text").alias("value")), 20_000)[1]


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_shipdate < TIMESTAMP '1996-01-01' AND l_quantity < 10")
def map_only_filter(spark, d):
    return table(spark, d, "lineitem").where("l_shipdate < TIMESTAMP_NTZ '1996-01-01' AND l_quantity < 10").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net"))


# keys and partitions


@query(f"SELECT c_custkey, c_name, ({_hash_sql('c_name')})::BIGINT AS hash FROM customer")
def java_like_hash(spark, d):
    return table(spark, d, "customer").select("c_custkey", "c_name", keys.hash_code(F.col("c_name")).alias("hash"))


@query(f"SELECT word, ({_hash_sql('word')})::BIGINT AS hash FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[ \\n]+')) AS word FROM documents) WHERE word <> ''")
def hash_of_words(spark, d):
    words = patterns.postings(table(spark, d, "documents")).select("word").distinct()
    return words.select("word", keys.hash_code(F.col("word")).alias("hash"))


_ORDER_LINE = "o_orderkey || chr(9) || o_orderpriority || ' ' || o_orderstatus || chr(9)"


@query(f"SELECT o_orderkey, {_fields_sql('line', 2, chr(9) + ' ')} AS key, (({_hash_sql(f'({_fields_sql("line", 1, chr(9) + " ")})')}) % 7)::BIGINT AS reduce_no FROM (SELECT o_orderkey, {_ORDER_LINE} AS line FROM orders)")
def keyfield_partition(spark, d):
    line = F.concat(F.col("o_orderkey").cast("string"), F.lit("\t"), "o_orderpriority", F.lit(" "), "o_orderstatus", F.lit("\t"))
    key, number = keys.key_field(F.col("line"), 7, "\t ", 2, 1)
    return table(spark, d, "orders").select("o_orderkey", line.alias("line")).select("o_orderkey", key.alias("key"), number.alias("reduce_no"))


@query("SELECT event_id, 'INT_HASH' AS kind, event_type AS key, user_id % 5 AS reduce_no FROM events UNION ALL SELECT event_id, 'KEY_FIELD', CAST(user_id AS VARCHAR), 0 FROM events")
def partitioner_choice(spark, d):
    """By name: inthash takes the leading number, any other name hashes key fields (one partition here)."""
    line, parts = F.concat_ws(" ", F.col("user_id").cast("string"), "event_type"), []
    for name, n in (("IntHash", 5), ("anything", 1)):
        kind = keys.Partitioner.named(name)
        key, number = keys.partition(kind, F.col("line"), n, " ")
        parts.append(table(spark, d, "events").select("event_id", line.alias("line")).select("event_id", F.lit(kind.name).alias("kind"), key.alias("key"), number.alias("reduce_no")))
    return parts[0].union(parts[1])


@query("SELECT event_id, event_type AS key, (user_id - 60) % 7 AS reduce_no FROM events")
def inthash_partition(spark, d):
    line = F.concat((F.col("user_id") - 60).cast("string"), F.lit(" "), "event_type", F.lit("\t"), F.col("value").cast("string"))
    key, number = keys.int_hash(F.col("line"), 7)
    return table(spark, d, "events").select("event_id", line.alias("line")).select("event_id", key.alias("key"), number.alias("reduce_no"))


@query(f"SELECT reduce_no, count(*)::BIGINT AS n FROM (SELECT (({_hash_sql('p_brand')}) % 16)::BIGINT AS reduce_no FROM part) GROUP BY reduce_no")
def partition_sizes(spark, d):
    return shuffle.partition_sizes(table(spark, d, "part").select((keys.hash_code(F.col("p_brand")) % 16).alias("reduce_no")))


@query("SELECT user_id % 6 AS reduce_no, count(*)::BIGINT AS n, min(event_id) AS first_id, 1::BIGINT AS places FROM events GROUP BY 1")
def route_to_reducers(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.col("user_id") % 6).alias("reduce_no"))
    routed = shuffle.sorted_reducers(rows, 6, keys=("event_id",)).withColumn("place", F.spark_partition_id())
    return routed.groupBy("reduce_no").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.count_distinct("place").alias("places"))


# sort, merge, sorted tables


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def secondary_sort_first(spark, d):
    """The first row of each key of rows that are sorted by key and time, as a reducer reads them."""
    rows = shuffle.secondary_sort(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])
    return patterns.first_of(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT event_id, user_id, (sum(event_id) OVER w)::BIGINT AS running, lag(event_id) OVER w AS previous FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_in_key(spark, d):
    return patterns.running(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_id").select("event_id", "user_id", "running", "previous")


def _sorted_orders(spark, d):
    at = scratch.path(spark, "kv")
    pairs = table(spark, d, "orders").select(F.format_string("key_%09d", "o_orderkey").alias("key"), F.col("o_orderpriority").alias("value"))
    sorted_kv.write(pairs, at)
    return at


@query("SELECT printf('key_%09d', o_orderkey) AS key, o_orderpriority AS value FROM orders WHERE printf('key_%09d', o_orderkey) >= 'key_000000123' AND printf('key_%09d', o_orderkey) < 'key_000001123'")
def sortedkv_range(spark, d):
    return sorted_kv.scan(spark, _sorted_orders(spark, d), "key_000000123", "key_000001123")


@query("SELECT printf('key_%09d', c_custkey * 7) AS key, coalesce(o_orderpriority, 'NOT_FOUND') AS value FROM customer LEFT JOIN orders ON c_custkey * 7 = o_orderkey")
def sortedkv_seek(spark, d):
    wanted = table(spark, d, "customer").select(F.format_string("key_%09d", F.col("c_custkey") * 7).alias("key"))
    return sorted_kv.seek(spark.read.parquet(_sorted_orders(spark, d)), wanted)


@query("SELECT printf('key_%09d', o_orderkey) AS key, part AS value FROM (SELECT o_orderkey, 'even' AS part FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'odd' FROM orders WHERE o_orderkey % 2 = 1 UNION ALL SELECT o_orderkey, 'third' FROM orders WHERE o_orderkey % 3 = 0)")
def kway_merge(spark, d):
    orders, paths = table(spark, d, "orders"), []
    for name, where in (("even", "o_orderkey % 2 = 0"), ("odd", "o_orderkey % 2 = 1"), ("third", "o_orderkey % 3 = 0")):
        paths.append(scratch.path(spark, name))
        sorted_kv.write(orders.where(where).select(F.format_string("key_%09d", "o_orderkey").alias("key"), F.lit(name).alias("value")), paths[-1], 2)
    return sorted_kv.merge(spark, paths)


@query("SELECT row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place, o_orderkey FROM orders ORDER BY place LIMIT 100")
def topk_orders(spark, d):
    best = patterns.top(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, [F.desc("o_totalprice"), "o_orderkey"])
    return best.select(F.row_number().over(Window.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("place"), "o_orderkey")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey")
def total_order(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderdate").orderBy("o_orderdate", "o_orderkey")


# aggregation and statistics


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY ALL")
def combiner_sum(spark, d):
    rows = table(spark, d, "lineitem").withColumn("one", F.lit(1).cast("long"))
    out = shuffle.combined(rows, ["l_returnflag", "l_linestatus"], n="one", quantity="l_quantity", price="l_extendedprice")
    return out.select("l_returnflag", "l_linestatus", "n", F.round("quantity", 2).alias("quantity"), F.round("price", 2).alias("price"))


@query("SELECT event_type AS counter, sum(user_id)::BIGINT AS total FROM events GROUP BY event_type")
def counter_lines(spark, d):
    lines = table(spark, d, "events").select(F.concat(F.lit("reporter:counter:group:"), "event_type", F.lit(","), F.col("user_id").cast("string")).alias("value"))
    noise = lines.limit(3).select(F.lit("reporter:counter:x,many").alias("value")).union(lines.limit(1).select(F.lit("plain text")))
    return stats.counters(lines.union(noise))


_STATES = ["pending", "running", "failed", "killed", "completed"]


@query("SELECT user_id, count(*)::BIGINT AS total, " + ", ".join(f"count(*) FILTER (WHERE event_id % 5 = {i})::BIGINT AS {s}" for i, s in enumerate(_STATES)) + " FROM events GROUP BY user_id")
def task_state_stats(spark, d):
    state = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("event_id") % 5 + 1).cast("int"))
    return stats.state_table(table(spark, d, "events").select("user_id", state.alias("state")), "user_id")


@query("""WITH t AS (SELECT event_type, event_id % 5 AS s, (event_id % 900)::BIGINT AS seconds FROM events),
  g AS (SELECT event_type, count(*) AS total, count(*) FILTER (WHERE s = 4) AS done, count(*) FILTER (WHERE s = 1) AS running, count(*) FILTER (WHERE s IN (2, 3)) AS lost,
    coalesce(sum(seconds) FILTER (WHERE s = 4), 0) AS done_s, coalesce(sum(seconds) FILTER (WHERE s = 1), 0) AS running_s FROM t GROUP BY event_type)
  SELECT event_type, floor(((done_s // done) * total - done_s - running_s) / (done / (done + lost)) / greatest(running, 1))::BIGINT AS left_seconds FROM g""")
def job_time_to_go(spark, d):
    state = F.element_at(F.array(*map(F.lit, _STATES)), (F.col("event_id") % 5 + 1).cast("int"))
    return stats.times_to_go(table(spark, d, "events").select("event_type", state.alias("state"), (F.col("event_id") % 900).alias("seconds")), "event_type")


@query("""SELECT event_type, n, v[least(floor(n*0.9), n-1)::BIGINT + 1] AS p90, v[least(floor(n*0.99), n-1)::BIGINT + 1] AS p99, v[least(floor(n*0.999), n-1)::BIGINT + 1] AS p999,
  v[least(floor(n*0.9999), n-1)::BIGINT + 1] AS p9999, v[n] AS longest, mean, len(list_filter(v, lambda x: x < mean))::BIGINT AS below_mean
  FROM (SELECT event_type, count(*)::BIGINT AS n, list_sort(list(s)) AS v, (sum(s) // count(*))::BIGINT AS mean FROM (SELECT event_type, floor(value * 60)::BIGINT AS s FROM events) GROUP BY event_type)""")
def duration_percentiles(spark, d):
    return stats.durations(table(spark, d, "events").select("event_type", F.floor(F.col("value") * 60).alias("seconds")), ["event_type"], "seconds")


@query("SELECT o_orderpriority, o_orderstatus, count(*)::BIGINT AS n, grouping(o_orderpriority, o_orderstatus)::BIGINT AS level FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def cube_counts(spark, d):
    return table(spark, d, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_keys(spark, d):
    return table(spark, d, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("SELECT word, count(*)::BIGINT AS n_docs, min(doc_id) AS first_doc FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\n]+')) AS word FROM documents) WHERE word <> '' GROUP BY word")
def inverted_index(spark, d):
    return patterns.inverted_index(table(spark, d, "documents"))


# joins and sets


@query("SELECT o_orderpriority, count(*)::BIGINT AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def repartition_join(spark, d):
    joined = patterns.reduce_side_join(table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), table(spark, d, "orders"), ["o_orderkey"])
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("SELECT n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def broadcast_join(spark, d):
    joined = patterns.map_side_join(table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey"), table(spark, d, "nation"), ["n_nationkey"])
    return joined.groupBy("n_name").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def semi_join(spark, d):
    rich = table(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(rich, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND o_totalprice > 300000)")
def anti_join(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'F' AND o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT 'union' AS op, count(*)::BIGINT AS n FROM (SELECT l_suppkey FROM lineitem UNION SELECT s_suppkey FROM supplier) UNION ALL SELECT 'intersect', count(*)::BIGINT FROM (SELECT l_orderkey FROM lineitem INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'except', count(*)::BIGINT FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def set_operations(spark, d):
    col = lambda t, c: table(spark, d, t).select(F.col(c).alias("k"))
    made = {
        "union": col("lineitem", "l_suppkey").union(col("supplier", "s_suppkey")).distinct(),
        "intersect": col("lineitem", "l_orderkey").intersect(col("orders", "o_custkey")),
        "except": col("customer", "c_custkey").subtract(col("orders", "o_custkey")),
    }
    parts = [f.agg(F.count("*").alias("n")).select(F.lit(n).alias("op"), "n") for n, f in made.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# programs and jobs


@query("SELECT event_type, count(*)::BIGINT AS n FROM events GROUP BY event_type")
def pipe_uniq_count(spark, d):
    rows = table(spark, d, "events").select(F.col("event_type").alias("value"))
    routed = shuffle.sorted_reducers(rows.withColumn("reduce_no", keys.hash_code(F.col("value")) % 4), 4, keys=("value",)).select("value")
    counted = pipes.lines(routed, "uniq -c")
    return counted.select(F.regexp_extract("value", r"^\s*\d+ (.*)$", 1).alias("event_type"), F.regexp_extract("value", r"^\s*(\d+) ", 1).cast("long").alias("n"))


@query("SELECT CAST(event_id AS VARCHAR) AS key, props AS value FROM events")
def pipe_pairs(spark, d):
    made = pipes.pairs(table(spark, d, "events").select(F.col("event_id").cast("string").alias("key"), F.col("props").alias("value")), "cat")
    return made.select(F.col("key").cast("string"), F.col("value").cast("string"))


@query("SELECT o_orderpriority AS counter, count(*)::BIGINT AS total FROM orders GROUP BY 1")
def pipe_counters(spark, d):
    rows = table(spark, d, "orders").select(F.concat(F.lit("reporter:counter:"), "o_orderpriority", F.lit(",1")).alias("value"))
    return pipes.reported(rows, "cat 1>&2")


@query("SELECT o_orderpriority AS key, count(*)::BIGINT AS n FROM orders GROUP BY o_orderpriority")
def map_reduce_job(spark, d):
    source, out = scratch.path(spark, "job-in"), scratch.path(spark, "job-out")
    writers.text(table(spark, d, "orders").select(F.concat("o_orderpriority", F.lit("\t1")).alias("value")), source)
    spec = JobSpec(inputs=(source,), output=out, mapper="cat", combiner="cat", reducer="cut -f1 | uniq -c | sed 's/^ *//'", reduces=3, name="counts")
    job.run(spark, spec)
    return readers.text(spark, out).select(F.regexp_extract("value", r"^\d+ (.*)$", 1).alias("key"), F.regexp_extract("value", r"^(\d+) ", 1).cast("long").alias("n"))


@query("SELECT 'lines' AS name, 'counts 3 1048576 sent' AS value, count(*)::BIGINT AS n FROM orders GROUP BY ALL")
def task_environment(spark, d):
    """A mapper knows its job, the memory limit, the user's own variables and a shipped file."""
    source, shipped = _written(spark, table(spark, d, "orders").select(F.col("o_orderkey").cast("string"))), f"{tempfile.mkdtemp(prefix='sluice-ship-')}/sent.txt"
    with open(shipped, "w") as f:
        f.write("sent")
    mapper = "sed \"s/.*/$LABEL\t$mapred_job_name $mapred_reduce_tasks $mapred_memory_limit $(cat sent.txt)/\""
    spec = JobSpec(inputs=(source,), output=scratch.path(spark, "env"), mapper=mapper, reducer="cat", reduces=3, name="counts", files=(shipped,), environment=(("LABEL", "lines"),))
    job.run(spark, spec)
    pair = F.split("value", "\t")
    return readers.text(spark, spec.output).groupBy(pair[0].alias("name"), pair[1].alias("value")).agg(F.count("*").alias("n"))


@query("SELECT 'left' AS side, count(*)::BIGINT AS n, true AS whole FROM nation UNION ALL SELECT 'right', count(*)::BIGINT, true FROM region")
def inputs_by_file(spark, d):
    """A mapper tags its lines by the file and range that it reads, as reduce-side joins through programs do."""
    at = scratch.path(spark, "sides")
    writers.text(table(spark, d, "nation").select("n_name"), f"{at}/left")
    writers.text(table(spark, d, "region").select("r_name"), f"{at}/right")
    mapper = 'case "$map_input_file" in */left/*) side=left ;; *) side=right ;; esac; sed "s/.*/$side $map_input_start $([ $map_input_length -gt 0 ] && echo yes)/"'
    rows = job.plan(spark, JobSpec(inputs=(f"{at}/*",), output="none", mapper=mapper, reduces=0))
    part = F.split("value", " ")
    return rows.groupBy(part[0].alias("side")).agg(F.count("*").alias("n"), F.every((part[1] == "0") & (part[2] == "yes")).alias("whole"))


@query("SELECT 'lines' AS counter, count(*)::BIGINT AS total FROM orders UNION ALL SELECT 'reduced', count(DISTINCT o_orderpriority)::BIGINT FROM orders")
def job_counters(spark, d):
    """What mappers and reducers report, over all tasks of a job."""
    source = _written(spark, table(spark, d, "orders").select("o_orderpriority"))
    mapper = """awk '{ print; print "reporter:counter:g:lines,1" > "/dev/stderr" }'"""
    reducer = """uniq | awk '{ print; print "reporter:counter:reduced,1" > "/dev/stderr" }'"""
    jobs = job.Jobs(spark)
    one = jobs.submit(JobSpec(inputs=(source,), output=scratch.path(spark, "counted"), mapper=mapper, reducer=reducer, reduces=3, check_counters=True))
    return spark.createDataFrame(list(jobs.status(one)["counters"].items()), "counter string, total long")


@query("SELECT o_orderpriority AS key, count(*)::BIGINT AS n FROM orders GROUP BY o_orderpriority")
def combined_pairs(spark, d):
    """Pairs through programs, with a combiner that sees each map task's sorted pairs."""
    at = scratch.path(spark, "pairs")
    writers.sequence_file(table(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.lit("1").alias("value")), at)
    spec = JobSpec(inputs=(at,), output="none", mapper="cat", combiner="cat", reducer="cat", reduces=3, pipe=Pipe.BISTREAMING, input_format=readers.InputFormat.SEQUENCE)
    return job.plan(spark, spec).groupBy(F.col("key").cast("string").alias("key")).agg(F.count("*").alias("n"))


# value formats


@query("SELECT p_partkey, p_name FROM part WHERE p_type GLOB '*A?*' OR p_brand GLOB 'Brand#?3'")
def wildcard_match(spark, d):
    return table(spark, d, "part").where(values.matches(F.col("p_type"), "*A?*") | values.matches(F.col("p_brand"), "Brand#?3")).select("p_partkey", "p_name")


@query("SELECT s_suppkey, 'host' || s_nationkey AS host, CASE WHEN s_suppkey % 2 = 0 THEN 9000 ELSE 54310 END AS port, '/data/' || s_suppkey AS path FROM supplier")
def address_parse(spark, d):
    uri = F.concat(F.lit("hdfs://host"), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 2 == 0, ":9000").otherwise(""), F.lit("/data/"), F.col("s_suppkey").cast("string"))
    host, port, path = values.address_columns(F.col("uri"))
    return table(spark, d, "supplier").select("s_suppkey", uri.alias("uri")).select("s_suppkey", host.alias("host"), port.alias("port"), path.alias("path"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp, CASE WHEN event_id > 3600 THEN (event_id // 3600) || ' hours, ' ELSE '' END || CASE WHEN event_id % 3600 > 60 THEN (event_id % 3600 // 60) || ' mins, ' ELSE '' END
  || CASE WHEN event_id % 60 > 0 THEN (event_id % 60) || ' sec' ELSE '' END || '; ' || event_id AS took FROM events""")
def duration_format(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"), values.duration_column(F.col("event_id")).alias("took"))
