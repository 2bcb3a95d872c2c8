"""op9 on passages that its first sentence rule missed."""

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from heatloom.llm import span_dedup, text
from tests.llm.test_kernels import plain_words


def passage(rng, sizes, ends=(". ", "! ", "\n")):
    """Sentences of the given numbers of words that no other passage has."""
    return "".join(" ".join(f"w{rng.randrange(1 << 40)}" for _ in range(n)) + rng.choice(ends) for n in sizes)


def kept_words(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"].split() for r in span_dedup.drop_repeated_sentences(docs).orderBy("doc_id").collect()]


def test_passages_of_short_sentences(spark):
    rng = random.Random(1)
    for sizes in ([5] * 11, [1] * 55, [3, 1, 8, 2, 2, 2, 9, 1, 1, 12, 1, 1, 1, 1, 1, 6]):
        shared, own = passage(rng, sizes), [passage(rng, [7, 9, 4, 30]) for _ in range(4)]
        first, second = kept_words(spark, [own[0] + shared + own[1], own[2] + shared + own[3]])
        assert first == (own[0] + shared + own[1]).split() and second == (own[2] + own[3]).split()


def test_passages_inside_sentences(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(60)]
    for lead, end in ((0, 0), (5, 3), (11, 40), (25, 8), (36, 1)):
        before, after = ([f"x{rng.randrange(1 << 40)}" for _ in range(n)] for n in (lead, end))
        _, second = kept_words(spark, [" ".join(words), " ".join(before + words + after)])
        assert len(set(second) & set(words)) <= 20 and set(second) >= set(before + after)


def test_pieces_are_bounded():
    rng = random.Random(3)
    for ranks in (range(300), range(300, 0, -1), [7] * 300, [rng.randrange(9) for _ in range(300)]):
        hashes = np.array(ranks, np.uint64)
        found = text.Words(hashes, np.zeros(300, np.int64), np.arange(300) * 2, np.arange(300) * 2 + 1)
        starts = span_dedup.piece_starts(np.full(600, 97, np.uint8), found, 10)
        assert starts[0] == 0 and np.diff(np.append(starts, 300)).max() <= 10


def grams(words, size):
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)}


def assert_no_passage_stays(before, after):
    """By words alone: no 51 words of a smaller id's text or twice in one text; texts that share no 16 words are whole."""
    low = lambda r: -1 if r[0] is None else r[0]
    shared = Counter(g for _, t in before for w in [plain_words(t)] for g in [tuple(w[k : k + 16]) for k in range(len(w) - 15)])
    left = {(i, t) for i, t in after}
    for i, t in before:
        if all(shared[g] == 1 for g in grams(plain_words(t), 16)):
            assert (i, t) in left
    outs, seen = {}, set()
    for i, t in after:
        outs.setdefault(-1 if i is None else i, []).append(plain_words(t))
    for i in sorted({low(r) for r in before}):
        for w in outs.get(i, []):
            assert len(grams(w, 51)) == max(0, len(w) - 50) and not grams(w, 51) & seen
        seen.update(*(grams(plain_words(r[1]), 51) for r in before if low(r) == i))


def plain(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_no_shared_passage_stays(spark):
    rng = random.Random(4)
    shapes = ([5] * 30, [1] * 100, [60, 60], [200], [11] * 12, [3, 25, 1, 1, 40, 2, 9, 9, 30])
    passages = [passage(rng, rng.choice(shapes)).split(" ") for _ in range(12)]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            p = rng.choice(passages)
            at = rng.randrange(len(p))
            parts += [passage(rng, [rng.randrange(1, 40) for _ in range(2)]) + passage(rng, [rng.randrange(1, 30)], [" "]), " ".join(p[at : at + rng.randrange(40, 140)]) + " "]
        texts.append((len(texts), "".join(parts)))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    assert_no_passage_stays(texts, plain(span_dedup.drop_repeated_sentences(docs)))


def test_no_shared_passage_of_the_tables_stays(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert_no_passage_stays(plain(docs), plain(span_dedup.drop_repeated_sentences(docs)))
    stage = dict(corpus_pipeline.STAGES)["substring_dedup"]
    assert_no_passage_stays(plain(docs), plain(stage(spark, docs, data)))
