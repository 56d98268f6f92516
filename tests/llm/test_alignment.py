import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from clausemill.llm import alignment
from clausemill.llm.alignment import align, hashed_counts, pieces
from clausemill.llm.perfect_hash import PerfectHash
from clausemill.llm.queries import QUERIES
from clausemill.llm.word_bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "  ", "\n", "a", "a ", "a  ", " a", "  a  b ", "tab\tand\n newline \n", "x\n  y", "don't  we'll it's", "<|endoftext|> in text", "<s> </s> <unk> <0x41>",
    "U+2581 ▁ here", "▁", "zwölf Größe déjà vu", "合同自双方签字 盖章之日起生效", "😀 👩‍👩‍👧 end", "a b 　 c", "nul \x00 x", "\x1c \x1d", "á ﻿ b", "1234567 12 345 !!! ??", "))\r\n ;\r x",
    "x" * 700 + " " + "y" * 700, "word " * 9000, "=" * 5000, "� ​",
]


def brute(texts):
    """Both libraries over each whole text, tokens compared one by one."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = {letter: byte for byte, letter in enumerate(byte_letters())}

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    found = []
    for text in texts:
        tokens_a, tokens_b = [], []
        if text:
            tokens_a = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
            tokens_b = [(i, bytes_b(i)) for i in b.encode(text)]
            body = (" " + text).encode()
            if b"".join(t for _, t in tokens_a) != body or b"".join(t for _, t in tokens_b) != body:
                tokens_a, tokens_b = [], []
        spans = []
        for tokens in (tokens_a, tokens_b):
            at, out = 0, []
            for i, t in tokens:
                out.append((i, at, at + len(t)))
                at += len(t)
            spans.append(out)
        links, j = [], 0
        for i, start, end in spans[0]:
            while j and spans[1][j][1] > start:
                j -= 1
            while j < len(spans[1]) and spans[1][j][1] < end:
                if spans[1][j][2] > start:
                    links.append((i, spans[1][j][0]))
                j += 1
            j = max(0, j - 1)
        common = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, x, y = [], 0, 0
        for end in common:
            left, right = [], []
            while x < len(spans[0]) and spans[0][x][2] <= end:
                left.append(str(spans[0][x][0]))
                x += 1
            while y < len(spans[1]) and spans[1][y][2] <= end:
                right.append(str(spans[1][y][0]))
                y += 1
            groups.append(",".join(left) + "|" + ",".join(right))
        found.append((len(spans[0]), len(spans[1]), links, groups))
    counts = Counter(p for _, _, links, _ in found for p in set(links))
    highest = Counter()
    for (i, _), n in counts.items():
        highest[i] = max(highest[i], n)
    return [
        (na, nb, len(groups), len(links), sum(counts[p] == highest[p[0]] for p in links), sum(counts[p] for p in links), ";".join(groups))
        for na, nb, links, groups in found
    ]


def rows(frame):
    out = align(frame, A, B).collect()
    return {(r["doc_id"], tuple(r)[1:]) for r in out}, len(out)


def test_given_texts_equal_both_libraries(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    expected = {d: row for (d, _), row in zip(docs, brute([t for _, t in docs]))}
    got = QUERIES["op12_tokenizer_alignment"](spark, FOLDER).collect()
    assert len(got) == len(docs)
    for r in got:
        row = expected[r["doc_id"]]
        assert tuple(r)[1:7] == row[:6]
        assert r["groups_sha256"] == (hashlib.sha256(row[6].encode()).hexdigest() if row[6] else "")


def test_odd_texts_equal_both_libraries(spark):
    docs = [(d, t) for d, t in enumerate(ODD)] + [(3, "repeated row here"), (3, "repeated row here"), (None, "no key here")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, body string, n_a int").repartition(4)
    expected = list(zip([d for d, _ in docs], brute([t for _, t in docs])))
    got, n = rows(frame)
    assert n == len(docs) and got == set(expected)


@pytest.mark.parametrize("size", [1, 700])
def test_blocks_give_the_same_sums(spark, monkeypatch, size):
    monkeypatch.setattr(alignment, "SHARD_PAIRS", 400)
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", size)
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    monkeypatch.setattr(alignment, "COUNTED", 300)
    draw = random.Random(5)
    words = "the lender borrower agreement shall terminate whereas notwithstanding payable instalments 12.5% ₹5,000".split()
    docs = [(d, " ".join(draw.choices(words, k=draw.randrange(1, 30)))) for d in range(60)] + [(1, "payable shall"), (None, "the lender"), (7, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    if size == 1:
        small = [d for d in docs if d[0] is None or d[0] < 9]
        docs, frame = small, spark.createDataFrame(small, "doc_id long, text string").repartition(5)
    got, n = rows(frame)
    assert n == len(docs) and got == set(zip([d for d, _ in docs], brute([t for _, t in docs])))


def test_counts_of_a_pair_in_very_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(alignment, "FAN_IN", 3)
    counted = spark.range(0, 40000, 1, 37).selectExpr("id % 90 * 65536 + id % 7 AS pair", "id % 3 AS n")
    hashed, shards, size = hashed_counts(counted)
    expected = {r["pair"]: r["n"] for r in counted.groupBy("pair").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    found = {}
    for r in hashed.collect():
        found |= dict(zip(np.frombuffer(r["pairs"], np.int64).tolist(), np.frombuffer(r["counts"], np.int64).tolist()))
    assert found == expected and size == len(expected) and shards == 1


def test_empty_table(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert align(frame, A, B).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in align(nothing, A, B).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2


def test_pieces_give_the_text_back():
    for text in ODD:
        if text:
            assert " ".join(pieces(text, True)) == text and pieces(text, False) == [text]


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 40, 50000))
    made = PerfectHash.build(keys)
    assert sorted(made(keys).tolist()) == list(range(len(keys)))
    other = np.setdiff1d(keys + 1, keys)
    assert (made(other) == -1).all()
    assert PerfectHash.build(np.zeros(0, np.int64))(np.array([1])).tolist() == [-1]
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([5, 5]))
