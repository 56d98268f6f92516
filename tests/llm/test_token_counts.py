import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clausemill.llm.queries import QUERIES
from clausemill.llm.queries_tokens import vocabulary_path
from clausemill.llm.token_counts import BYTE_SCORE, SPACE, WHITE_SPACE, Counter, scores_at, token_counts

PATH = vocabulary_path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.001"
TOY = {SPACE: -1.0, "a": -2.0, "b": -2.5, "ab": -3.0, "aba": -4.0, SPACE + "a": -2.0, "ba": -3.5}


def plain(word, scores):
    """The best split of one pre-token, from the end backwards and without sharing."""
    text = SPACE + word
    best = {len(text): (0.0, 0)}
    for start in range(len(text) - 1, -1, -1):
        size = len(text[start].encode())
        score, tokens = best[start + 1]
        options = [(score + size * BYTE_SCORE, tokens + size)]
        for end in range(start + 1, len(text) + 1):
            if text[start:end] in scores:
                options.append((best[end][0] + scores[text[start:end]], best[end][1] + 1))
        best[start] = max(options, key=lambda o: (round(o[0], 6), -o[1]))
    return best[0][1]


@given(st.lists(st.text("abc", max_size=8), max_size=20))
@settings(max_examples=200, deadline=None)
def test_shared_prefixes_give_the_same_counts(words):
    counter = Counter(TOY, 3)
    got = counter.insert(sorted(set(words)))
    assert got == {w: plain(w, TOY) for w in words}
    nodes = {(SPACE + w)[:n] for w in words for n in range(1, len(w) + 2)}
    assert counter.steps == len(nodes)


def test_query_equals_plain_splits(spark):
    scores, _ = scores_at(PATH)
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    known = {}
    rows = QUERIES["op3_token_counts"](spark, FOLDER).collect()
    assert len(rows) == len(texts)
    for r in rows[:60]:
        words = WHITE_SPACE.findall(texts[r["doc_id"]])
        for w in words:
            if w not in known:
                known[w] = plain(w, scores)
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(known[w] for w in words))


def test_unigram_library_agrees():
    from tokenizers import Tokenizer, models

    scores, longest = scores_at(PATH)
    vocabulary = [("<unk>", -100.0), *scores.items()]
    library = Tokenizer(models.Unigram(vocabulary, 0, False))
    words = ["house", "internationalisation", "xq", "don't", "Haus", "a" * 20, "the", "zzzz"]
    got = Counter(scores, longest).insert(words)
    for w in words:
        assert got[w] == len(library.encode(SPACE + w).ids)


def test_edges(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "the " * 200000), (5, "x" * 20000), (None, "the house"), (6, "the house"), (6, "the house"), (7, "日本𓀀  the")]
    docs = spark.createDataFrame([(*r, 3, "n") for r in rows], "doc_id long, text string, n_tokens int, n string").repartition(2)
    got = [(r["doc_id"], r["n_words"], r["n_tokens"]) for r in token_counts(docs, PATH).collect()]
    scores, _ = scores_at(PATH)
    the, house = plain("the", scores), plain("house", scores)
    by = {g[0]: g[1:] for g in got}
    assert len(got) == len(rows) and by[1] == by[2] == by[3] == (0, 0)
    assert by[4] == (200000, 200000 * the) and by[None] == by[6] == (2, the + house)
    assert by[7] == (2, plain("日本𓀀", scores) + the) and by[5][0] == 1
    assert token_counts(docs.limit(0), PATH).count() == 0
    monkeypatch.setattr("clausemill.llm.token_counts.REMEMBERED", 3)
    counter = Counter(*scores_at(PATH))
    assert counter.texts(["the house", "a b c d", "the house"])[2] == (2, the + house)
    assert pytest.approx(BYTE_SCORE) == -30.0
