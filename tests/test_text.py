import random
import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lodestone.functions import text as tx
from lodestone.functions.tokenizer import WordPiece, encode_column
from lodestone.operators.chunking import fixed_chunks, token_chunks
from lodestone.sources.extract import clean_text, decode_utf8


def test_fixed_chunks(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "héllo wörld"), (4, "a\nb\n" * 4), (5, "x" * 30_000)], "doc_id long, text string").withColumn("chunk_index", F.lit(9))
    rows = fixed_chunks(df, "doc_id", "text", 5).orderBy("id", "chunk_index").collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    assert sorted(by) == [3, 4, 5]
    assert "".join(r.content for r in by[3]) == "héllo wörld"
    assert [(r.start_line, r.end_line) for r in by[4]] == [(1, 3), (3, 6), (6, 8), (8, 9)]
    assert len(by[5]) == 6000
    with pytest.raises(ValueError):
        fixed_chunks(df, "doc_id", "text", 0)


def test_token_chunks(spark):
    df = spark.createDataFrame([(1, "abcde fghij " * 20), (2, "abcde"), (3, "")], "doc_id long, text string")
    rows = token_chunks(df, "doc_id", "text", len, 10, 100).orderBy("id", "chunk_index").collect()
    assert max(len(r.content) for r in rows) <= 10
    assert "".join(r.content for r in rows if r.id == 1) == "abcde fghij " * 20
    hard = token_chunks(df, "doc_id", "text", lambda t: 5 * len(t), 2).where("id = 2").collect()
    assert len(hard) == 5
    assert len(token_chunks(df, "doc_id", "text", None, 0).where("id = 1").collect()) == 1


def test_expressions(spark):
    df = spark.createDataFrame([("  a   b\n\nc" + "x" * 200,)], "t string")
    s = df.select(tx.snippet(F.col("t"))).first()[0]
    assert s.startswith("a b c") and len(s) == 153
    assert df.select(tx.file_uri(F.lit("/a b/ü.txt"))).first()[0] == "file:///a%20b/%C3%BC.txt"
    assert df.select(tx.hyperlink(F.lit("/a"), F.lit("a:1-2"))).first()[0] == "\x1b]8;;file:///a\x1b\\a:1-2\x1b]8;;\x1b\\"
    assert df.select(tx.elapsed(F.lit(12.34))).first()[0] == "12.3s" and df.select(tx.elapsed(F.lit(125))).first()[0] == "2m05s"
    assert df.select(tx.page_marked(F.lit(2), F.lit("a  \n\n\nb"))).first()[0] == "--- page 2 ---\na\n\nb\n"
    assert df.select(tx.strip_accents(F.lit("Café"))).first()[0] == "Cafe"
    assert df.select(tx.pre_tokens(F.lit("search. $100"))).first()[0] == ["search", ".", "$", "100"]


def test_clean_extracted_against_the_loop(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("a \t\n\r") for _ in range(rng.randint(0, 20))) for _ in range(300)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", tx.clean_extracted(F.col("t")).alias("c")).collect()
    assert all(r.c == clean_text(texts[r.i]) for r in got)


def test_invalid_bytes():
    assert decode_utf8(b"a\xe2\x82A") == "a��A" and decode_utf8("é😀".encode()) == "é😀"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=30))
def test_decoding_never_fails(raw):
    text = decode_utf8(raw)
    assert len(text) <= len(raw)


VOCAB = {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "index", "##es", "cafe", "search", ".", "$", "100", "the"])}


def test_word_pieces(spark):
    t = WordPiece(VOCAB, 8)
    assert t.tokens("Indexes the Café.") == ["index", "##es", "the", "cafe", "."]
    assert t.tokens("😀😀😀") == ["[UNK]"] and t.tokens("$100") == ["$", "100"]
    ids, mask, types = t.encode("the " * 20)
    assert len(ids) == 8 and ids[0] == 2 and ids[-1] == 3 and sum(mask) == 8 and types == [0] * 8
    assert t.encode("")[0] == [2, 3, 0, 0, 0, 0, 0, 0]
    rows = spark.createDataFrame([(1, "search"), (2, None)], "i int, t string").select("i", encode_column(F.col("t"), t).alias("e")).orderBy("i").collect()
    assert rows[0].e.ids[:3] == [2, 7, 3] and rows[1].e is None
    with pytest.raises(ValueError):
        WordPiece({"a": 0})
    assert WordPiece(VOCAB, max_word=3).tokens("search") == ["[UNK]"]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=127), max_size=40))
def test_plain_text_is_normalised_as_any_other(text):
    t = WordPiece(VOCAB)
    assert t.normalize(text) + "  é"[1:].replace("é", "e") == t.normalize(text + " é")


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_count_is_the_number_of_tokens(text):
    t = WordPiece(VOCAB)
    assert t.count(text) == len(t.tokens(text)) and not re.search(r"\s", "".join(t.words(t.normalize(text))))


def test_uris_by_hand(spark):
    want = {"/a~b:c@d+e&f": "file:///a~b:c@d+e&f", "/x y/ü?#%2F.md": "file:///x%20y/%C3%BC%3F%23%252F.md", "/p(1)'!*[a],b;c=d$": "file:///p%281%29%27%21%2A%5Ba%5D,b;c=d$", "/-_.": "file:///-_."}
    df = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r.p: r.u for r in df.select("p", tx.file_uri(F.col("p")).alias("u")).collect()} == want
