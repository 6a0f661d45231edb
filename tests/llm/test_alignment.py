"""Alignment of two tokenizers against whole texts, token by token, with the libraries alone."""

import functools
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelfmark.llm import token_alignment
from shelfmark.llm.token_alignment import MODEL_A, MODEL_B, Aligner, align_documents, op13_token_alignment

PATHS = public_tokenizers.path(MODEL_A), public_tokenizers.path(MODEL_B)


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


@functools.cache
def byte_table():
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table, n = {}, 0
    for b in range(256):
        table[chr(b) if b in printable else chr(256 + n)] = b
        n += b not in printable
    return table


def token_bytes_a(tok):
    return bytes(byte_table()[c] for c in tok)


def aligned(plain, text):
    """Groups [(a ids, b ids)] of a text by walking over all ends; None without tokens."""
    if not text:
        return None
    ta, tb = plain
    whole = (" " + text).encode()
    ids_a, ids_b = ta.encode(" " + text, add_special_tokens=False).ids, tb.encode(text)
    raw_a = [token_bytes_a(ta.id_to_token(i)) for i in ids_a]
    raw_b = [bytes([int(tb.id_to_piece(i)[3:5], 16)]) if tb.is_byte(i) else tb.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(raw_a) != whole or b"".join(raw_b) != whole:
        return None
    groups, i, j = [], 0, 0
    while i < len(ids_a):
        a, b, x, y = [ids_a[i]], [ids_b[j]], len(raw_a[i]), len(raw_b[j])
        i, j = i + 1, j + 1
        while x != y:
            if x < y:
                a.append(ids_a[i])
                x += len(raw_a[i])
                i += 1
            else:
                b.append(ids_b[j])
                y += len(raw_b[j])
                j += 1
        groups.append((a, b))
    return groups


def brute(plain, rows):
    """The rows of the query, in the order of ``rows``."""
    every = [aligned(plain, t) for _, t in rows]
    links = [Counter((a, b) for x, y in g or [] for a in x for b in y) for g in every]
    counts = Counter(p for one in links for p in one)
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    out = []
    for (doc, _), g, one in zip(rows, every, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g or [])
        n_best = sum(m for (a, b), m in one.items() if counts[a, b] == top[a])
        sums = (sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), sum(one.values()), n_best, sum(m * counts[p] for p, m in one.items()))
        out.append((doc, *sums, hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


ODD = [
    None, "", " ", "   ", "a", "\n", "\n\n", "a\n\nb", "a\n \nb", "end.\n\n\nNext", "end.\nNext word's can't I'll", "x  y   z  ", " lead", "tab\tand\r\nline", "a,\n,b", "a,b;c", "Straße, Übung\nÄrger!",
    "<|endoftext|> and </s> <s> <unk>", "one ▁ two", "▁", "日本語テキスト、これは。", "Привет, мир!\nКак дела?", "éà, ö\nn", "👩‍👩‍👧‍👦 family\n🙂,ok", "    x  y", "\x00 nul\x01", "ſtrange ǅ\nı", "aaaaaaaa" * 400, "ab,cd.\n" * 300, "¹²³ ½ ٣٤\n५",
]


def test_whole_table(spark, sf_dir, plain):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert rows_of(op13_token_alignment(spark, docs)) == sorted(brute(plain, rows), key=str)


@pytest.mark.parametrize("hot", [0, 40, 1_000_000])
def test_odd_texts_and_pairs_that_are_joined(spark, plain, hot):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, ODD[10]), (3, ODD[10]), (None, ODD[16]), (None, None)]
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, pairs int, groups string, row int")
    assert rows_of(op13_token_alignment(spark, docs, hot)) == sorted(brute(plain, rows), key=str)


def test_cut_texts_equal_whole_ones(plain):
    rng = random.Random(7)
    parts = ["word", "Word", " ", "  ", "\n", "\n\n", ",", ".", "...", "'s", "'", "’", "12", "é", "ß", "Жук", "字", "\t", " ", "　", "!", "?", "(", "-", "_", "🙂", "́", "x1", "\r\n", ":", "ll"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(4000)]
    own = Aligner(*PATHS)
    assert own.cuts
    found = own.align(texts)
    for text, got in zip(texts, found["groups"], strict=True):
        expected = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in aligned(plain, text) or [])
        assert got.decode() == expected, repr(text)


def test_a_full_memory_starts_afresh(monkeypatch, spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect()]
    own = Aligner(*PATHS)
    whole = own.align(texts)["groups"]
    monkeypatch.setattr(token_alignment, "MAX_PIECES", 50)
    assert [own.align([t])["groups"][0] for t in texts] == whole
    own.cuts = False
    assert own.align(texts)["groups"] == whole


def test_groups_as_text_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "Hello there"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in align_documents(docs, *PATHS, with_groups=True).collect()}
    assert hashlib.sha256(got[1]["groups"].encode()).hexdigest() == got[1]["groups_sha256"] and got[1]["n_groups"] == 2
    assert (got[2]["groups"], got[2]["groups_sha256"], got[2]["n_a"]) == ("", "", 0)
    assert op13_token_alignment(spark, docs.where("doc_id > 2")).count() == 0
