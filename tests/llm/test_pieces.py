"""op8 against greedy matching over the whole vocabulary file, the bare blank included."""

import json
import random
import time

import numpy as np
import pytest

from heatloom.llm import piece_counts, queries, text, tokens

WORDS = ["работа", "русский", "считать", "территория", "что", "一二三四五六七八九十", "中文", "한국어", "😀", "words", "naïve", "ÿ", "x" * 40]


def whole_vocabulary():
    alphabet = piece_counts.byte_alphabet()
    with open(tokens.default_tokenizer(), encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    return {bytes(alphabet[c] for c in p) for p in vocabulary if all(c in alphabet for c in p)}


def test_words_that_no_piece_begins(spark, tmp_path):
    pieces = whole_vocabulary()
    longest = max(map(len, pieces))

    def greedy(word):
        n = 0
        while word:
            size = next(k for k in range(min(longest, len(word)), 0, -1) if word[:k] in pieces)
            word, n = word[size:], n + 1
        return n

    rows = [(k, w) for k, w in enumerate(WORDS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: (r["n_words"], r["n_pieces"], r["n_unknown"]) for r in queries.QUERIES["op8_piece_counts"](spark, str(tmp_path)).collect()}
    assert found == {k: (1, greedy(b" " + w.encode()), 0) for k, w in rows}


def random_words(rng, alphabet, count, longest):
    return [bytes(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(count)]


@pytest.mark.parametrize("part", [1, 3, 64])
def test_long_words_in_parts(monkeypatch, part):
    """Any cut gives what greedy matching gives, for vocabularies that do not come back into step, too."""
    monkeypatch.setattr(piece_counts, "PART", part)
    rng = random.Random(part)
    vocabularies = [
        ({b"a", b"ab", b"b"}, {b"a", b"b", b"aa", b"aab", b"bbbb", b"abab"}),
        ({b"", b"abc"}, {b"a" * k for k in (1, 2, 7)} | {b"b", b"ba", b"c" * 5}),
        ({b"aaa"}, {b"aa", b"b"}),
    ]
    for begin, go_on in vocabularies:
        words = random_words(rng, b"ab", 80, 40) + random_words(rng, b"aaaab", 80, 300) + random_words(rng, b"abc", 80, 200) + [b"a" * 1000, b"a" * 1001, b"ab" * 700, b"b" * 999]
        data = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum([len(w) for w in words])
        got = piece_counts.Automaton(begin, go_on).pieces(data, end - [len(w) for w in words], end)

        def greedy(word):
            n, pieces = 0, begin
            while word or pieces is begin:
                size = next((k for k in range(len(word), -1, -1) if word[:k] in pieces and (k or pieces is begin)), None)
                if size is None:
                    return -1
                word, n, pieces = word[size:], n + 1, go_on
            return n

        assert got.tolist() == [greedy(w) for w in words]


def test_text_without_breaks_is_not_slower_by_far():
    machine = piece_counts.automaton(tokens.default_tokenizer(), True)
    rng = random.Random(3)
    english = " ".join(rng.choice(["the", "weather", "of", "tomorrow", "is", "uncertain", "again"]) for _ in range(160_000)).encode()[: 1 << 20]
    chinese = "".join(chr(rng.randint(0x4E00, 0x5E00)) for _ in range((1 << 20) // 3)).encode()
    took = []
    for raw in (english, chinese):
        data = np.frombuffer(raw, np.uint8)
        found = text.words(data, np.array([0, len(data)]))
        machine.pieces(data, found.start, found.end)
        began = time.process_time()
        n = machine.pieces(data, found.start, found.end)
        took.append(time.process_time() - began)
    assert len(n) == 1 and n[0] > 200_000
    assert took[1] < 12 * took[0] + 0.5, took
