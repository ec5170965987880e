import random
import unicodedata

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemill.llm import bpe

PARTS = ["abc", "aaa", " ", "\n\t", "'s", "'ll", "ÀÉ", "ß", "Σς", "12", "½", "!?", "日本", "😀", "İ", "é", "<|endoftext|>", "<|startoftext|>", "<|x", "\x1c", "\x85", " ", "_", "'S"]


def test_codec_equals_the_library():
    lib, codec = Tokenizer.from_file(bpe.vocabulary()), bpe.Codec(bpe.vocabulary())
    rnd = random.Random(2)
    texts = ["", "x", "a" * 3000, "ab" * 900, "".join(rnd.choice("etaoinsh") for _ in range(3000))]
    texts += ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(1, 40))) for _ in range(1500)]
    ids, counts = codec.encode(texts)
    at = np.r_[0, np.cumsum(counts)]
    decoded = codec.decode(ids, counts)
    for i, e in enumerate(lib.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[i] : at[i + 1]].tolist() == e.ids, texts[i]
        assert decoded[i].decode() == lib.decode(e.ids, skip_special_tokens=False)


def test_every_code_point():
    """Each alone between letters, and as a mark among other marks, which tells its place in the normal form."""
    lib, codec = Tokenizer.from_file(bpe.vocabulary()), bpe.Codec(bpe.vocabulary())
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    marks = [c for c in chars if unicodedata.combining(c)] + [chr(0x11930), chr(0x11938)]
    texts = [f"a{c}b" for c in chars] + [f"a{c}\u0323" for c in marks] + [f"a\u0345{c}" for c in marks] + [chr(0x11935) + c + chr(0x11930) for c in marks]
    for k in range(0, len(texts), 20_000):
        ids, counts = codec.encode(texts[k : k + 20_000])
        at = np.r_[0, np.cumsum(counts)]
        assert not [t for i, (t, e) in enumerate(zip(texts[k : k + 20_000], lib.encode_batch(texts[k : k + 20_000], add_special_tokens=False), strict=True)) if ids[at[i] : at[i + 1]].tolist() != e.ids]


def test_decoding_in_small_runs(spark, monkeypatch):
    rows = [(i, [7 * j % 400 for j in range(i * i)]) for i in range(12)] + [(20, None)]
    df = spark.createDataFrame(rows, "doc_id long, ids array<int>").coalesce(1)
    codec = bpe.Codec(bpe.vocabulary())
    want = {i: codec.decode(np.array(x or [], np.int64), np.array([len(x or [])]))[0].decode() for i, x in rows}
    assert {r["doc_id"]: r["text"] for r in bpe.decode(df).collect()} == want


def test_cache_can_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    codec = bpe.Codec(bpe.vocabulary())
    first = [codec.encode([t])[0].tolist() for t in ("one two three", "four five six", "one two three")]
    assert first[0] == first[2]


def test_operators(odd_docs, no_docs):
    lib = Tokenizer.from_file(bpe.vocabulary())
    encoded = bpe.encode(odd_docs)
    decoded = {r["doc_id"]: r["text"] for r in bpe.decode(encoded).collect()}
    rows = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    got = encoded.collect()
    assert len(got) == odd_docs.count()
    for r in got:
        ids = lib.encode(rows[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids"] == ids and decoded[r["doc_id"]] == lib.decode(ids, skip_special_tokens=False)
    assert bpe.digests(no_docs).count() == 0
    assert bpe.digests(odd_docs).where(F.col("doc_id") < 4).agg(F.sum("n_tokens")).first()[0] == 0
    assert bpe.decode(encoded.withColumn("ids", F.lit(None).cast("array<int>"))).where("text != ''").count() == 0
