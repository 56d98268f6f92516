"""Unigram token counts, worked out over a trie of the pre-tokens."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a pre-token starts with: it stands for the white space before the word.
SPACE = "▁"
#: Words whose pre-tokens are inserted together, about; words a worker remembers counts for, unless they are longer.
BATCH_WORDS = 50_000
REMEMBERED = 400_000
LONG_WORD = 256
WHITE_SPACE = re.compile(r"[^\x09-\x0d\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Score of a byte of a character that no piece covers: below every piece, so it is a last resort.
BYTE_SCORE = -30.0


def piece_scores(path: str) -> dict[str, float]:
    """A unigram score for each whole piece of a sentencepiece vocabulary: the Zipf share of its rank, as a logarithm.

    The files hold no unigram probabilities, so the rank (the id, frequent pieces first) stands for the frequency.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    norm = math.log(sum(1 / rank for rank in range(1, len(ids) + 1)))
    return {model.id_to_piece(i): -math.log(rank) - norm for rank, i in enumerate(ids, 1)}


@functools.cache
def scores_at(path: str) -> tuple[dict[str, float], int]:
    scores = piece_scores(path)
    return scores, max(map(len, scores))


class Counter:
    """Token counts of words, with the forward scores of shared prefixes worked out once.

    Each trie node is a prefix of a pre-token and keeps its forward step: the best score of any split of the prefix and
    the number of tokens of that split (the fewest of equally good ones). A node's step needs only its ancestors, so
    words with a common beginning share it. The words of a batch are inserted in sorted order, and only the path to the
    current node is kept, so the trie takes the memory of one word; the counts at the ends of words are stored.
    """

    def __init__(self, scores: dict[str, float], longest: int):
        self.scores, self.longest = scores, longest
        self.counts: dict[str, int] = {}
        self.steps = 0  # trie nodes made so far

    def _step(self, path: list[tuple[float, int]], word: str, end: int) -> None:
        """Append the step of the prefix ``word[:end]``, whose ancestors' steps are in ``path``."""
        self.steps += 1
        scores = self.scores
        size = len(word[end - 1].encode("utf-8", "replace"))
        score, tokens = path[end - 1]
        best, fewest = score + size * BYTE_SCORE, tokens + size
        for start in range(max(0, end - self.longest), end):
            piece = scores.get(word[start:end])
            if piece is not None:
                score, tokens = path[start]
                score += piece
                if score > best or score == best and tokens + 1 < fewest:
                    best, fewest = score, tokens + 1
        path.append((best, fewest))

    def insert(self, words: list[str]) -> dict[str, int]:
        """The token counts of distinct ``words``."""
        out: dict[str, int] = {}
        path: list[tuple[float, int]] = [(0.0, 0)]
        last = ""
        for word in sorted(words):
            prefix = SPACE + word
            shared = 0
            for a, b in zip(prefix, last):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(prefix) + 1):
                self._step(path, prefix, end)
            out[word] = path[-1][1]
            last = prefix
        return out

    def texts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """The word and token counts of whole texts: sums over their words."""
        found = [WHITE_SPACE.findall(t or "") for t in texts]
        missing = {w for words in found for w in words}.difference(self.counts)
        if len(self.counts) + len(missing) > REMEMBERED:
            self.counts = {}
            missing = {w for words in found for w in words}
        fresh = self.insert(list(missing))
        known = self.counts
        known.update(fresh)
        totals = [(len(words), sum(map(known.__getitem__, words))) for words in found]
        for word in fresh:
            if len(word) > LONG_WORD:
                del known[word]
        return totals


def _parts(texts: pd.Series) -> Iterator[list]:
    """Texts in order, together about as many words as are inserted at once."""
    part, size = [], 0
    for text in texts:
        part.append(text)
        size += len(text or "")
        if size >= 6 * BATCH_WORDS:
            yield part
            part, size = [], 0
    if part:
        yield part


def token_counts(docs: DataFrame, vocabulary_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_words`` and ``n_tokens`` of each row's whole text under the vocabulary's unigram scores.

    A text is split at white space; each word, with the space mark before it, takes the split into pieces with the best
    total score, and of equally good ones the one with the fewest pieces; a character without a piece counts its bytes.
    Null, empty and blank texts have 0. Rows are counted one by one without a shuffle, so keys may be null or repeat.
    """

    @F.pandas_udf("n_words long, n_tokens long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = Counter(*scores_at(vocabulary_path))
        for texts in batches:
            counts = [n for part in _parts(texts) for n in counter.texts(part)]
            yield pd.DataFrame(counts, columns=["n_words", "n_tokens"], dtype="int64")

    return docs.select(F.col(key), count(F.col(text)).alias("n")).select(key, "n.n_words", "n.n_tokens")
