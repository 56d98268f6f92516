import functools
import hashlib
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clausemill.llm.automaton import Lexicon, compile_lexicon
from clausemill.llm.queries_tokens import vocabulary_path
from clausemill.llm.word_bpe import Encoder, build_lexicon, decode, encode, vocabulary

PATH = vocabulary_path("word_bpe_49k.json")


LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return LIBRARY


@given(st.dictionaries(st.binary(max_size=6), st.lists(st.integers(0, 9), max_size=3).map(tuple), max_size=40))
@settings(max_examples=60, deadline=None)
def test_lexicon_holds_exactly_its_words(entries):
    lexicon = Lexicon(compile_lexicon(list(entries.items())))
    asked = [*entries, *(word + b"x" for word in entries), b""]
    for word, rank in zip(asked, lexicon.ranks(asked).tolist()):
        assert (rank >= 0) == (word in entries)
        if rank >= 0:
            assert tuple(memoryview(lexicon.packed(rank)).cast("I")) == entries[word]


def test_suffixes_are_shared():
    few = compile_lexicon([(w, (1,)) for w in (b"walking", b"talking")])
    apart = compile_lexicon([(w, (1,)) for w in (b"walking", b"talkers")])
    assert len(few) < len(apart)


@functools.cache
def small_encoder():
    words = ["hello", "world", "don", "'t", "<", "Ã¶"]
    merges = vocabulary(PATH)
    return Encoder(PATH, compile_lexicon([(w.encode(), tuple(merges.merge(w))) for w in words]))


@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_equals_the_library(text):
    got = memoryview(small_encoder().texts([text])[0]).cast("I").tolist()
    assert got == LIBRARY.encode(text, add_special_tokens=False).ids


def test_every_latin_character_equals_the_library(library):
    one = small_encoder()
    for code in [*range(1, 0x600), *range(0x1E00, 0x2100), *range(0x3000, 0x3100)]:
        for text in (chr(code), f"a{chr(code)}́b", f"x {chr(code)} y"):
            assert memoryview(one.texts([text])[0]).cast("I").tolist() == library.encode(text, add_special_tokens=False).ids, code


CASES = [
    "Hello wörld's don't <|endoftext|>x<|STARTOFTEXT|> <|startoftext|>", "", None, "   \n\t ", "a" * 3000, "ab" * 40000,
    "ÇA Éé İstanbul ΣΑΣ ς 12½ ٣ 你好。   é \x1c\x1d", "hello hello hello", "hello hello hello",
]


def test_rows_round_trip_and_edges(spark, library):
    rows = [(i if i != 7 else None, t, "extra", b"1") for i, t in enumerate(CASES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, ids binary").repartition(3)
    for given in (None, build_lexicon(docs, PATH, limit=2)):
        got = {r["doc_id"]: bytes(r["ids"]) for r in encode(docs, PATH, lexicon=given).collect()}
        assert len(got) == len(CASES)
        for i, text, *_ in rows:
            assert memoryview(got[i]).cast("I").tolist() == library.encode(text or "", add_special_tokens=False).ids
    texts = {r["doc_id"]: r["text"] for r in decode(encode(docs, PATH), PATH).collect()}
    for i, text, *_ in rows:
        assert texts[i] == library.decode(library.encode(text or "", add_special_tokens=False).ids, skip_special_tokens=False)
    assert encode(docs.limit(0), PATH).count() == 0


def test_query_equals_the_library(spark, library):
    from clausemill.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = QUERIES["op10_bpe"](spark, folder).collect()
    assert len(rows) == len(texts) and sys.byteorder == "little"
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
