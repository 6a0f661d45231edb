"""Token counts and SentencePiece encoding against the libraries."""

import itertools
import random

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from shelfmark.llm import suffix_pieces, token_counts

TEXTS = [None, "", " ", "it's  x\n\n y's 's", "a<|endoftext|> b", "é" * 50, "日本語 text ٣٤", "x" * 5000, "word " * 3000, "\r\n\t", "▁ x", "ǅ😀<0x0A></s>"]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, 1, "z") for k, t in enumerate(texts)], "doc_id long, text string, n_tokens int, key string")


def test_counts_equal_the_library(spark):
    rows = TEXTS + TEXTS[3:5]
    docs = frame(spark, rows).union(frame(spark, rows).limit(4))  # repeated rows stay
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.op1_token_counts(spark, docs).collect())
    tok = token_counts.load(public_tokenizers.path(token_counts.VOCABULARY))
    want = []
    for r in docs.collect():
        n = len(tok.encode(r["text"] or "", add_special_tokens=False).ids)
        want.append((r["doc_id"], len((r["text"] or "").encode()), n, n > 512))
    assert got == sorted(want)


def test_rare_pretokens_are_joined(spark):
    docs = frame(spark, ["a b c d", "a b x y", "a"])
    path = public_tokenizers.path(token_counts.VOCABULARY)
    every = {h: sorted(map(tuple, token_counts.token_counts(docs, path, hot=h).collect())) for h in (0, 1, 100)}
    assert every[0] == every[1] == every[100]


def test_no_documents(spark):
    assert token_counts.op1_token_counts(spark, frame(spark, ["x"]).where("false")).count() == 0
    assert suffix_pieces.op2_sentencepiece(spark, frame(spark, ["x"]).where("false")).count() == 0


def _cutter():
    path = public_tokenizers.path(token_counts.VOCABULARY)
    return token_counts.Cutter(token_counts.class_runs(path), token_counts.special_strings(path)), token_counts.load(path)


@settings(max_examples=300, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "a", "é", "1", "²", ".", "!", " ", " ", "s", "re", "𝒳", "😀"]), max_size=12))
def test_pretokens_equal_the_splitter(parts):
    cutter, tok = _cutter()
    text = "".join(parts)
    names, _, which, times = cutter.cut([text])
    mine = sorted(x for a, b in zip(which, times, strict=True) for x in [names[a]] * int(b))
    assert mine == sorted(text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text))


def test_encoding_equals_the_library(spark, sf_dir):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(suffix_pieces.MODEL))
    docs = frame(spark, TEXTS).select("doc_id", "text").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    encoded = suffix_pieces.op2_sentencepiece(spark, docs)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    for r in encoded.collect():
        assert any(r["ids"] == sp.encode(t) for t in texts[r["doc_id"]])
        assert r["n_tokens"] == len(r["ids"])
        assert r["round_trip"] or any("▁" in t for t in texts[r["doc_id"]])
    back = suffix_pieces.decode_documents(encoded, public_tokenizers.path(suffix_pieces.MODEL))
    assert all(r["text"] in [t.replace("▁", " ") for t in texts[r["doc_id"]]] for r in back.collect())


def test_encoder_on_random_and_long_units():
    encoder = suffix_pieces.Encoder(suffix_pieces.read_vocabulary(public_tokenizers.path(suffix_pieces.MODEL)))
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(suffix_pieces.MODEL))
    rnd = random.Random(7)
    letters = list("abcdeiourstn  .,'\n\t0123éüñßИпр的一😀▁का-_=/<>") + ["the", "ing", " the", "\r\n"]
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 3000, "theingtion" * 500, " " * 1000, "=-" * 1000]
    ids, n = encoder.encode(texts)
    ends = np.concatenate([[0], np.cumsum(n)])
    assert all(ids[ends[k] : ends[k + 1]].tolist() == sp.encode(t) for k, t in enumerate(texts))
    again, _ = encoder.encode(texts)  # now from memory
    assert (again == ids).all()


def test_encoder_of_a_large_alphabet():
    """More than 255 letters in one batch, against merges done one by one."""
    rnd = random.Random(1)
    letters = [suffix_pieces.BLANK] + [chr(0x4E00 + k) for k in range(400)]
    pairs = ["".join(rnd.sample(letters[1:], 2)) for _ in range(900)]
    merged = list(dict.fromkeys(pairs + [rnd.choice(pairs) + rnd.choice(pairs) for _ in range(300)] + [rnd.choice(pairs) + rnd.choice(letters[1:]) for _ in range(300)]))
    rnd.shuffle(merged)
    n = len(merged) + len(letters)
    encoder = suffix_pieces.Encoder(suffix_pieces.arrange(merged, letters, list(range(n)), [b""] * n, np.full(256, -1, np.int32)))
    rank = {t: k for k, t in enumerate(merged + letters)}

    def one_by_one(text):
        parts = [suffix_pieces.BLANK, *text]
        while found := [(rank[a + b], k) for k, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in rank]:
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [rank[p] for p in parts]

    texts = ["".join(rnd.choice(pairs + letters[1:]) for _ in range(rnd.randint(1, 25))) for _ in range(300)]
    ids, sizes = encoder.encode(texts)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    assert all(ids[ends[k] : ends[k + 1]].tolist() == one_by_one(t) for k, t in enumerate(texts))
