"""Token ids, packing and the ORC store against the tokenizers library itself."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sluice.llm import packing, token_store, tokens
from sluice.llm.queries import vocabulary
from sluice.llm.tokens import Encoder, by_words

ODD = ["İstanbul ΣΑΣ x́ a b\x1cq it's 'Tis <|endoftext|> …!? ½ ２ ﬁ", None, "", "  ", " ́a", "naïve​z", "日本語 テスト", "Å ß ẞ", "don't, 'llama.", "a.b,c.", "été, ÉTÉ. été.", "x" * 5000, "\u0000a  b", "x <|endoftext|> y", "<|startoftext|>Ab<|endoftext|><|ENDOFTEXT|>", "end<|endoftext|"]


@pytest.fixture(scope="module")
def encoder():
    return Encoder(vocabulary(), memo=50)


@pytest.fixture(scope="module")
def fresh():
    """The library's own tokenizer, by its defaults."""
    return Tokenizer.from_file(vocabulary())


def encoded(encoder, texts):
    return [ids[a:b].tolist() for _, _, ids, at in encoder.encode(pa.array(texts, pa.string())) for a, b in zip(at[:-1], at[1:], strict=True)]


def test_odd_texts(encoder, fresh):
    assert encoder.by_word and encoder.by_letters
    assert encoded(encoder, ODD) == [fresh.encode(t or "", add_special_tokens=False).ids for t in ODD]
    assert encoded(encoder, ["x <|endoftext|> y"])[0].count(49407) == 1


@given(st.lists(st.one_of(st.text(max_size=40), st.sampled_from(["<|endoftext|>", "a<|startoftext|> b"])), max_size=8))
@settings(max_examples=80, deadline=None)
def test_any_text(encoder, fresh, texts):
    assert encoded(encoder, texts) == [fresh.encode(t, add_special_tokens=False).ids for t in texts]


def test_other_vocabularies_are_encoded_whole(fresh):
    import json

    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    other, plain = Encoder(path), Tokenizer.from_file(path)
    assert not other.by_word
    assert encoded(other, ODD) == [plain.encode(t or "", add_special_tokens=False).ids for t in ODD]
    rules = json.loads(fresh.to_str())
    assert by_words(rules)
    for change in ({"normalizer": None}, {"post_processor": {"type": "ByteLevel"}}, {"added_tokens": [{**rules["added_tokens"][0], "normalized": True}]}):
        assert not by_words(rules | change)


@pytest.fixture(scope="module")
def docs(spark, small):
    extra = spark.createDataFrame([(None, "no id", "c"), (5_000, None, "c"), (5_001, "", "c"), (5_001, "", "c"), (5_002, "word " * 9000, "c"), (5_003, "one<|endoftext|>two <|startoftext|>", "c")], "doc_id long, text string, ids string")
    return spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", F.lit("clash").alias("ids")).union(extra).repartition(7)


def expected(fresh, docs, end):
    rows = docs.collect()
    return sorted(((r.doc_id is None, r.doc_id or 0, fresh.encode(r.text or "", add_special_tokens=False).ids + [end]) for r in rows), key=lambda r: r[:2])


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_store_round_trip(spark, docs, fresh, tmp_path):
    at = f"file://{tmp_path}/tokens"
    token_store.write(docs, at, vocabulary())
    want, place = [], 0
    for _, i, ids in expected(fresh, docs, 1):
        want.append((i, place, len(ids), crc(ids)))
        place += len(ids)
    got = sorted((r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_store.index(spark, at).collect())
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_store.read(spark, at).where("doc_id = 5002").count() == 1
    import pyarrow.orc as orc

    files = list(tmp_path.glob("tokens/*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files) == docs.count()


def test_stripes_filters_and_indexes(spark, tmp_path):
    """Files hold several stripes, row indexes and Bloom filters; filters on ids skip stripes; stripes are read apart."""
    import pyarrow.orc as orc

    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(600)), lambda i: F.concat(F.lit("w"), F.pmod(F.xxhash64("id", i), F.lit(50_000)).cast("string"))), " ")
    docs = spark.range(0, 30_000, 1, 4).select((F.col("id") * 2).alias("doc_id"), text.alias("text"))
    at = f"file://{tmp_path}/striped"
    token_store.write(docs, at, vocabulary(), shards=1)
    (file,) = tmp_path.glob("striped/*.orc")
    read = orc.ORCFile(file)
    assert read.nstripes > 1 and read.nrows == 30_000
    assert sum(read.read_stripe(k, ["doc_id"]).num_rows for k in range(read.nstripes)) == 30_000
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{file}"), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == token_store.STRIDE
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
    kinds = {footer.getStreams(i).getKind().toString() for i in range(footer.getStreamsCount())}
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    rows = token_store.read(spark, at)
    # the second id lies within the bounds but no document has it: its Bloom filters leave nothing to read
    for wanted, n, most in (("doc_id = 30000", 1, token_store.STRIDE), ("doc_id = 30001", 0, token_store.STRIDE), ("doc_id >= 59990", 5, token_store.STRIDE)):
        found = rows.where(wanted).select("doc_id", "n_tokens")
        assert len(found.collect()) == n
        read_rows = found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
        assert read_rows <= most


def test_store_empty(spark, docs, tmp_path):
    token_store.write(docs.limit(0), f"file://{tmp_path}/none", vocabulary())
    assert token_store.index(spark, f"file://{tmp_path}/none").count() == 0


def check_packing(rows, length):
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= length
    return len(places)


def test_packing(spark, docs, fresh):
    rows = packing.pack(docs, vocabulary()).collect()
    want = []
    for _, i, ids in expected(fresh, docs, 0):
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), crc(ids[k : k + 2048])) for k in range(0, len(ids), 2048)]
    assert sorted((r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    sequences = check_packing(rows, 2048)
    assert sequences <= 1.02 * -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack(docs.limit(0), vocabulary()).count() == 0


@given(st.lists(st.integers(1, 64), min_size=1, max_size=300))
@settings(max_examples=60, deadline=None)
def test_plan_holds_all(lengths):
    counts = np.bincount(lengths, minlength=65)
    held = np.zeros(65, int)
    packed = packing.plan(counts, 64)
    for pattern, times in packed:
        assert sum(pattern) <= 64 and times > 0
        for n in pattern:
            held[n] += times
    assert (held == counts).all()
    assert sum(t for _, t in packed) <= 1.5 * -(-sum(lengths) // 64) + 1


def test_plan_is_tight_at_scale():
    draw = np.random.default_rng(1)
    counts = np.bincount(np.clip(draw.lognormal(6, 1, 200_000).astype(int), 1, 2048), minlength=2049)
    total = int((counts * np.arange(2049)).sum())
    assert sum(t for _, t in packing.plan(counts)) <= 1.002 * -(-total // 2048)


def test_words_that_end_with_signs_go_straight_to_the_model(fresh, monkeypatch):
    """Each ending is tried once, not each word with it."""
    own = Encoder(vocabulary())
    words = [f"{w}{s}" for s in ("", "!!", "&&&", ".,", "'", "…", "***") for w in ("heating", "été", "Straße", "naïve", "x1", "don't")]
    asked, real = [], own._plain
    monkeypatch.setattr(own, "_plain", lambda texts: (asked.extend(texts), real(texts))[1])
    assert encoded(own, [" ".join(words)]) == [fresh.encode(" ".join(words), add_special_tokens=False).ids]
    assert not {"été&&&", "naïve!!", "Straße***"} & set(asked) and len(asked) < len(words)


def test_a_word_is_learned_once_whatever_sign_ends_it(fresh):
    """Before letters (a-z) and digits, and only where a single sign ends the word."""
    own = Encoder(vocabulary())
    texts = ["dog dog, dog. dog! Dog; 7, 7", "dog,", "dog.,dog., ", "été, 'dog' dog", "dog's dog_ dog", ""]
    assert encoded(own, texts) == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    assert {w for w in own.codes if w.startswith(b"dog")} == {b"dog", b"dog,", b"dog.,dog.,", b"dog's"}
    assert own.known == len(own.codes) and not own.codes.fresh


def test_a_task_of_packing_leaves_no_words_to_later_stages():
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["some words here", "and others"]})
    pieces = [r for b in packing._pieces(iter([batch]), vocabulary(), 2048, 0) for r in b.to_pylist()]
    assert [r["doc_id"] for r in pieces] == [1, 2]
    assert not tokens.encoder(vocabulary()).codes and tokens.encoder(vocabulary()).used == 0
