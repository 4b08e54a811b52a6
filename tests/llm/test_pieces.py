"""Pieces against the sentencepiece library, and the alignment of two tokenizers against a plain version."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidemark.llm import alignment, common, pieces
from tidemark.llm.token_ids import token_bytes, vocabulary

MODEL = pieces.piece_model(pieces.VOCABULARY)
LIBRARY = SentencePieceProcessor(model_file=vocabulary(pieces.VOCABULARY))
ALPHABET = "abcTheandin  \t\n\r\x00\x85\xa0012,.=-_'<s>0x4é☃日本▁\U0001f600"


def plain_rows(awkward):
    df = awkward.toDF(*[f"x{i}" for i in range(len(awkward.columns))]).selectExpr("x0 as doc_id", "x1 as text")
    return [(r["doc_id"], r["text"] or "") for r in df.collect()]


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(ALPHABET), max_size=60))
def test_ids_as_the_library(text):
    assert np.frombuffer(MODEL.encode(text), "<u4").tolist() == LIBRARY.encode(text)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert np.frombuffer(MODEL.encode(text), "<u4").tolist() == LIBRARY.encode(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(3, 258), st.sampled_from([0, 1, 2, 29_871, 259, 229, 155, 134])), max_size=10))
def test_text_of_any_ids(ids):
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


def test_long_stretch_without_spaces():
    text = "thequickbrownfox" * 3000 + "=" * 5000
    assert np.frombuffer(MODEL.encode(text), "<u4").tolist() == LIBRARY.encode(text)


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(pieces, "MOST_STRETCHES", 3)
    model = pieces.PieceModel(pieces.VOCABULARY)
    for text in ("one two three four five six one two", "seven eight", "one nine"):
        assert np.frombuffer(model.encode(text), "<u4").tolist() == LIBRARY.encode(text)
    assert set(model.known) == {"▁one", "▁nine", "▁seven", "▁eight"}


def test_one_by_one_as_together():
    words = sorted({w for w in "▁the▁quick ▁unbelievable▁ ▁▁▁▁x aaaaaaaaaaa thethethe ▁12.5% ▁don't éèê".split() if w})
    for w in words:
        if all(MODEL.number[ord(c)] >= 0 for c in w):
            assert MODEL.merged_together([w, w]) == [MODEL.packed(w)] * 2


def test_other_vocabularies_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(vocabulary(pieces.VOCABULARY), "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.add_dummy_prefix = False
    (tmp_path / "other.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="merge-type vocabulary"):
        pieces.PieceModel(str(tmp_path / "other.model"))


def test_round_trip(spark, awkward):
    got = sorted((str(r["doc_id"]), bytes(r["ids"]), r["decoded"], r["n_tokens"], r["agrees"]) for r in pieces.round_trip(awkward).collect())
    want = []
    for d, t in plain_rows(awkward):
        ids = LIBRARY.encode(t, add_bos=True, add_eos=True)
        want.append((str(d), np.array(ids, "<u4").tobytes(), LIBRARY.decode(ids), len(ids), True))
    assert got == sorted(want)
    bare = pieces.round_trip(awkward, begin=False, end=False).where("doc_id = 2").first()
    assert bare["n_tokens"] == 0 and bytes(bare["ids"]) == b"" and bare["decoded"] == ""


def test_digests(spark, tmp_path):
    rows = [(1, "two words"), (2, None), (None, "é\n☃")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in pieces.op11_piece_round_trip(spark, str(tmp_path)).collect()}
    for d, t in rows:
        ids = LIBRARY.encode(t or "", add_bos=True, add_eos=True)
        assert got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[d]["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest() and got[d]["agrees"]


# ---------------------------------------------------------------- alignment


def plain_alignment(rows):
    first = Tokenizer.from_file(vocabulary(alignment.BYTE_LEVEL))
    first.encode_special_tokens = True
    spelt = token_bytes(alignment.BYTE_LEVEL)

    def piece(i):
        return bytes([int(LIBRARY.id_to_piece(i)[3:5], 16)]) if LIBRARY.is_byte(i) else LIBRARY.id_to_piece(i).replace("▁", " ").encode()

    found, count = [], Counter()
    for d, text in rows:
        a, b = first.encode(" " + text, add_special_tokens=False).ids, LIBRARY.encode(text)
        whole = f" {text}".encode()
        if not text or b"".join(spelt[i] for i in a) != whole or b"".join(map(piece, b)) != whole:
            a, b = [], []
        a_ends = np.cumsum([len(spelt[i]) for i in a]).tolist() if a else []
        b_ends = np.cumsum([len(piece(i)) for i in b]).tolist() if b else []
        groups, i, j = [], 0, 0
        b_at = {e: k + 1 for k, e in enumerate(b_ends)}
        for k, e in enumerate(a_ends):
            if e in b_at:
                groups.append((a[i : k + 1], b[j : b_at[e]]))
                i, j = k + 1, b_at[e]
        links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        count.update(set(links))
        found.append((d, len(a), len(b), groups, links))
    best = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for d, n_a, n_b, groups, links in found:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        sha = hashlib.sha256(text.encode()).hexdigest() if groups else ""
        out.append((d, n_a, n_b, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), sha))
    return sorted(out, key=str)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("head", [1 << 17, 20])
def test_alignment(spark, head):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    assert as_rows(alignment.align(docs, head=head)) == plain_alignment(rows)


def test_awkward_alignment(spark, awkward):
    more = [(9, "a<|endoftext|>b </s> <0x41>"), (10, "with ▁ in it"), (11, "日本語日本語 ﬁ \U0001f600\U0001f600"), (12, "=" * 70 + "x" * 33)]
    df = common.only(awkward, "doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    assert as_rows(alignment.align(df)) == plain_alignment([(r["doc_id"], r["text"] or "") for r in df.collect()])
    assert as_rows(alignment.align(awkward)) == plain_alignment(plain_rows(awkward))


def test_groups_themselves(spark):
    df = spark.createDataFrame([(1, "the unbelievable truth"), (2, "")], "doc_id long, text string")
    cuts = alignment.cut(alignment.tokens(df))
    got = {r["doc_id"]: r for r in cuts.select("doc_id", "a", alignment.groups(alignment.numbers(F.size("a_at") - 1)).alias("groups")).collect()}
    assert [x for g in got[1]["groups"] for x in g["b"]] == LIBRARY.encode("the unbelievable truth") and not got[2]["groups"]
    assert [x for g in got[1]["groups"] for x in g["a"]] == got[1]["a"]


def test_empty(spark, empty):
    assert pieces.round_trip(empty).count() == 0
    assert alignment.align(empty).count() == 0
