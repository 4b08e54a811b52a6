"""Token ids, packing and the chunk store against the tokenizers library itself."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import chunk_store, common, packing
from tidemark.llm.token_ids import encoder, vocabulary

NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
LIBRARY = {n: Tokenizer.from_file(vocabulary(n)) for n in NAMES}
ALPHABET = "abcXYZ '’sStTéÉßñ½² \t\n\r\x0b\x1c\x85\xa0\xad012,.!?-_<|>'llİſǅ\x00×日本☃"


def ids_of(name, text):
    return LIBRARY[name].encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(ALPHABET), max_size=40), min_size=1, max_size=8))
def test_same_ids_as_the_library(name, texts):
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(name)(texts)] == [ids_of(name, t) for t in texts]


def test_new_pieces_are_not_split_again():
    """Pieces are spelt in the vocabulary's characters, so the library need not look for them: it parts lines only."""
    encode = encoder("byte_bpe_50k.json")
    pieces = [" word", "Überß", " 12", "!?", "\u010a", "x\u0085y", "\u00a0", " <|", "'s", "\x00\x7f\u00ad"]
    encode.learn(pieces)
    assert [encode.pieces[p] for p in pieces] == encode.encode(pieces)
    assert "ByteLevel" not in str(encode.bare.pre_tokenizer)


@pytest.mark.parametrize("name", NAMES)
def test_special_tokens_as_the_library(name):
    texts = ["a<|endoftext|>b", "<|startoftext|>", ""]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(name)(texts)] == [ids_of(name, t) for t in texts]


def by_id(df):
    return sorted(([None if v is None else v for v in r] for r in df.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_packing(spark, awkward):
    texts = awkward.toDF(*[f"x{i}" for i in range(len(awkward.columns))]).selectExpr("x0 as doc_id", "x1 as text")
    got = packing.pack(awkward, keep_ids=True).collect()
    want = sorted(([d, ids_of("word_bpe_49k.json", t) + [1]] for d, t in by_id(texts)), key=str)
    docs: dict = {}
    for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["doc_tokens"], r["sequence_id"])):
        ids = np.frombuffer(r["ids"], "<u4")
        assert r["offset"] == 0 and r["length"] == len(ids) and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048
        assert r["ids_crc32"] == crc32(r["ids"])
        docs.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids.tolist()))
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    lengths = [r["length"] for r in sorted(got, key=lambda r: r["sequence_id"])]
    assert lengths == sorted(lengths, reverse=True)
    once = {}
    for d, ids in want:
        once.setdefault((d, len(ids)), []).append(ids)
    assert {k: len(v) for k, v in once.items()} == {k: sum(s == 0 for s, _ in v) for k, v in docs.items()}
    for key, pieces in docs.items():
        starts = sorted({s for s, _ in pieces})
        built = [x for s in starts for x in next(p for q, p in pieces if q == s)]
        assert built in once[key]


def test_piece_lengths_are_binary():
    for n in (1, 2, 3, 2047, 2048, 2049, 10_000):
        lengths = packing.piece_lengths(n, 11)
        assert sum(lengths) == n and lengths == sorted(lengths, reverse=True) and len({x for x in lengths if x < 2048}) == len([x for x in lengths if x < 2048])


def test_store_round_trip(spark, awkward):
    texts = awkward.toDF(*[f"x{i}" for i in range(len(awkward.columns))]).selectExpr("x0 as doc_id", "x1 as text")
    path = common.work_path(spark, "test-store")
    chunk_store.write(awkward, path)
    back = sorted(chunk_store.documents(spark, path).collect(), key=lambda r: r["start"])
    want = [(d, ids_of("byte_bpe_50k.json", t) + [0]) for d, t in by_id(texts)]
    assert sorted(str((r["doc_id"], r["ids"])) for r in back) == sorted(str(w) for w in want)
    assert [r["doc_id"] for r in back if r["doc_id"] is not None] == sorted(d for d, _ in want if d is not None)
    at = 0
    for r in back:
        assert r["start"] == at
        at += len(r["ids"])
    sums = {r["start"]: (r["n_tokens"], r["ids_crc32"]) for r in chunk_store.verified(spark, path).collect()}
    assert sums == {r["start"]: (len(r["ids"]), crc32(np.array(r["ids"], "<u4").tobytes())) for r in back}
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("chunk").distinct().count()
    assert spark.read.parquet(f"{path}/manifest").orderBy("level", ascending=False).first()["n_tokens"] == at


def test_what_is_changed_in_a_store_is_found_out(spark, monkeypatch):
    monkeypatch.setattr(chunk_store, "FAN_OUT", 3)  # several levels of nodes
    path = common.work_path(spark, "test-store")
    chunk_store.write(spark.createDataFrame([(k, f"some words of document {k}") for k in range(20)], "doc_id long, text string"), path)
    assert chunk_store.verified(spark, path).count() == chunk_store.documents(spark, path).count() == 20
    assert spark.read.parquet(f"{path}/manifest").agg({"level": "max"}).first()[0] == 3

    def with_changed(name: str, *changed: str, where: str = "true") -> str:
        other = common.work_path(spark, "test-store")
        for table in ("chunks", "recipes", "manifest"):
            rows = spark.read.parquet(f"{path}/{table}")
            rows = rows.where(where).selectExpr(*changed or ["*"]) if table == name else rows
            rows.write.parquet(f"{other}/{table}")
        return other

    least = spark.read.parquet(f"{path}/chunks").selectExpr("hex(min(chunk))").first()[0]
    for other, told in (
        (with_changed("chunks", "chunk", f"if(hex(chunk) = '{least}', cast('xx' as binary), ids) as ids"), "doesn't have the bytes|don't give"),
        (with_changed("chunks", where=f"hex(chunk) <> '{least}'"), "don't give"),
        (with_changed("recipes", where="doc_id <> 7"), "differ below node"),
        (with_changed("recipes", "doc_id + 1 as doc_id", "n_tokens", "chunks", "root", "part"), "differ below node"),
        (with_changed("manifest", "level", "node", "documents", "n_tokens", "if(level = 2 and node = 1, sha2(hash, 256), hash) as hash"), "differ below node 1 of level 2"),
    ):
        for read in (chunk_store.verified, chunk_store.documents):
            with pytest.raises(Exception, match=told):
                read(spark, other).collect()


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 50_000, 20_000).astype("<u4")

    def chunks(ids):
        hits = (np.flatnonzero(chunk_store.rolling(ids) >> np.uint32(20) & np.uint32(chunk_store.ONE_IN - 1) == 0) + 1).tolist()
        ends = chunk_store.cuts(hits, 0, len(ids))
        return {ids[a:b].tobytes() for a, b in zip([0, *ends[:-1]], ends)}

    shifted = np.concatenate((rng.integers(0, 50_000, 100).astype("<u4"), body))
    a, b = chunks(body), chunks(shifted)
    assert len(a & b) >= len(a) - 3
    for parts in (a, b):
        assert all(len(p) // 4 <= chunk_store.MOST for p in parts)


@given(st.binary(max_size=300), st.binary(max_size=300))
def test_joined_checksums(a, b):
    assert chunk_store.crc_joined(crc32(a), crc32(b), len(b)) == crc32(a + b)


def test_empty(spark, empty):
    assert packing.pack(empty).count() == 0
    path = common.work_path(spark, "test-store")
    chunk_store.write(empty, path)
    assert chunk_store.verified(spark, path).count() == 0
