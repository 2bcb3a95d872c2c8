"""The numpy parts of the corpus operators against plain Python."""

import random
import re
from array import array
from collections import Counter
from fractions import Fraction
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from heatloom.llm import bag_minhash, block_search, packing, piece_counts, quality, records, span_dedup, suffix_dedup, text, tokens, url_filter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = st.lists(st.one_of(st.none(), st.text("abAB é1.!\n,ß ", max_size=40)), max_size=6)


def plain_words(t):
    return WORD.findall((t or "").translate(LOWER))


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.integers(0, 2))
def test_words_of_rows(texts, skip):
    column = pa.array(texts, pa.string())[min(skip, len(texts)) :]
    data, offsets = text.text_bytes(column)
    found = text.words(data, offsets)
    expected = [(r, w) for r, t in enumerate(column.to_pylist()) for w in plain_words(t)]
    assert [(r, bytes(data[a:b]).decode().translate(LOWER)) for r, a, b in zip(found.row, found.start, found.end, strict=True)] == expected
    assert len(set(found.hash.tolist())) == len({w for _, w in expected})
    bags = text.shingles(found, len(column), 3)
    for r, t in enumerate(column.to_pylist()):
        w = plain_words(t)
        k = min(3, len(w))
        assert sorted(bags.count[bags.row == r]) == (sorted(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)).values()) if w else [])


def test_blocks_cover_all_rows():
    offsets = np.array([0, 5, 5, 30, 31, 40])
    assert list(text.blocks(offsets, 10)) == [(0, 2), (2, 3), (3, 5)]
    assert list(text.blocks(np.array([0]), 10)) == []


def test_tokens_equal_whole_encoding():
    encode = tokens.encoder(tokens.default_tokenizer())
    rng = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "Bc", "é", "ß", "'t", "'S", "'", "12", "½", ",", ".", "-", "_", "　", "\xa0", "́", "中", "😀", "<|endoftext|>", "\x1f", "ŉ", " the"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert encode(t) == array("I", encode.tokenizer.encode(t, add_special_tokens=False).ids).tobytes(), repr(t)
    assert encode(None) == encode("") == b""
    small = tokens.Encoder(tokens.default_tokenizer(), room=3)
    assert small("one two three four one two three four") == encode("one two three four one two three four")


def test_encoder_remembers_many_words():
    """Unknown words are most of the cost of encoding, so each is asked for once while there is room."""
    encode, asked = tokens.Encoder(tokens.default_tokenizer()), []

    class Model:
        def tokenize(self, word):
            asked.append(word)
            return []

    encode.model = Model()
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [" " + "".join(x) for x in product(letters, letters, letters, letters[:22])]
    for w in words * 2:
        encode[w]
    assert len(asked) == len(words) == 386_672


@pytest.mark.parametrize("t", ["to be <|endoftext|> or not", "<|endoftext|>", "a\u00a0b  c", "a <|endoftext| >b", "x\u200by\n\n z"])
def test_special_tokens_and_blanks_equal_whole_encoding(t):
    encode = tokens.encoder(tokens.default_tokenizer())
    assert encode(t) == array("I", encode.tokenizer.encode(t, add_special_tokens=False).ids).tobytes()


def test_record_frames():
    import io

    ids = array("I", [1, 70_000, 2]).tobytes()
    assert records.unpack_ids(records.pack_ids(None, ids)) == (None, ids)
    short = array("I", [1, 2]).tobytes()
    assert records.unpack_ids(records.pack_ids(-5, short)) == (-5, short)
    framed = records.frame(b"abc") + records.frame(b"")
    stream = io.BytesIO(framed)
    assert [records.unframe(stream), records.unframe(stream), records.unframe(stream)] == [b"abc", b"", None]
    for spot in (0, 9, 13, 16):
        bad = bytearray(framed)
        bad[spot] ^= 1
        with pytest.raises(ValueError):
            records.unframe(io.BytesIO(bytes(bad)))


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=20))
def test_best_two_fit_uses_all(histogram):
    used = Counter()
    for times, bin_ in packing.best_two_fit(histogram, 64):
        assert times > 0 and sum(n * c for n, c in bin_.items()) <= 64
        for n, c in bin_.items():
            used[n] += times * c
    assert used == Counter(histogram)
    spans = {}
    for n, low, end, _, each, _ in packing.places(packing.best_two_fit(histogram, 64)):
        assert low == spans.get(n, 0) and (end - low) % each == 0
        spans[n] = end
    assert spans == histogram


def test_best_two_fit_replaces_the_smallest():
    # Greedy: 50 + 10, gap 4; 9 + 5 fit the widened gap of 14 wholly.
    assert packing.best_two_fit({50: 1, 10: 1, 9: 1, 5: 1}, 64)[0] == (1, {50: 1, 9: 1, 5: 1})


def test_piece_counts_equal_greedy_matching():
    begin, go_on = {b"ab", b"a", b"abcd", b"x"}, {b"c", b"cd", b"b", b"bc", b"d"}
    machine = piece_counts.Automaton(begin, go_on)
    rng = random.Random(1)
    found = [bytes(rng.choice(b"abcdx") for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    data = np.frombuffer(b"".join(found), np.uint8)
    end = np.cumsum([len(w) for w in found])
    got = machine.pieces(data, end - [len(w) for w in found], end)

    def greedy(word):
        n = at = 0
        while at < len(word):
            size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in (go_on if at else begin)), 0)
            if not size:
                return -1
            at, n = at + size, n + 1
        return n

    assert got.tolist() == [greedy(w) for w in found]


def bag(counts, salt):
    return text.mix(np.arange(len(counts), dtype=np.uint64) + np.uint64(salt * 1000)), np.array(counts)


def test_bag_minhash_estimates_without_bias():
    rng = np.random.default_rng(5)
    errors = []
    for k in range(60):
        a, b = rng.integers(1, 12, 40), rng.integers(1, 40, 40) * (rng.random(40) < 0.8)
        hashes, _ = bag(a, k)
        own = [(hashes, np.zeros(40, int), a), (hashes[b > 0], np.ones((b > 0).sum(), int), b[b > 0])]
        least = bag_minhash.signatures(text.Shingles(*(np.concatenate(x) for x in zip(*own, strict=True))), 3, 1024)
        assert np.isinf(least[2]).all()
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        errors.append(((least[0] == least[1]).mean() - true) / np.sqrt(true * (1 - true) / 1024))
    assert abs(np.mean(errors)) < 4 / np.sqrt(60) and 0.7 < np.std(errors) < 1.3


def test_bag_minhash_of_great_counts():
    """No count is too great: components agree as often as the bags are alike."""
    for counts, alike in (((600_000, 4_000_000), 0.15), (((4_000_000, 500_000, 0), (4_000_000, 0, 500_000)), 0.8)):
        bags = [c if isinstance(c, tuple) else (c,) for c in counts]
        h, row, count = zip(*((text.mix(np.array([k + 7], np.uint64))[0], r, n) for r, bag in enumerate(bags) for k, n in enumerate(bag) if n), strict=True)
        order = np.lexsort((h, row))
        shingles = text.Shingles(*(np.array(x)[order] for x in (h, row, count)))
        least = bag_minhash.signatures(shingles, 2, 1024)
        assert abs((least[0] == least[1]).mean() - alike) < 0.06, counts


def test_heaps_merge_in_any_pieces(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    rows = sorted({(int(q), 0, int(v), float(s)) for q, v, s in zip(rng.integers(0, 40, 3000), rng.integers(0, 500, 3000), rng.integers(0, 60, 3000), strict=True)})
    batches = lambda x: [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*x[k : k + 100], strict=True)], ["query_id", "query_key", "vec_id", "score"]) for k in range(0, len(x), 100)]
    monkeypatch.setattr(block_search, "HEAPS", 5)
    mixed = [rows[k] for k in rng.permutation(len(rows))]
    partly = sorted(r for b in block_search._merge(7, False, iter(batches(mixed))) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    found = sorted(r for b in block_search._merge(7, True, iter(batches(partly))) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    wanted = []
    for q in range(40):
        best = sorted((s, v) for query, _, v, s in rows if query == q)[:7]
        wanted += [(q, 0, v, s, k + 1) for k, (s, v) in enumerate(best)]
    assert found == sorted(wanted)


def test_links_join_what_is_similar():
    rng = random.Random(2)
    for _ in range(30):
        bags = [Counter({s: rng.randint(1, 3) for s in rng.sample(range(12), rng.randint(1, 8))}) for _ in range(20)]
        rows = [(s, r, c) for r, b in enumerate(bags) for s, c in sorted(b.items())]
        hashes, row, count = (np.array(x) for x in zip(*rows, strict=True))
        a, b = bag_minhash.link(text.Shingles(hashes.astype(np.uint64), row, count), len(bags), 0.6)
        parent = list(range(20))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for x, y in zip(a, b, strict=True):
            assert bag_minhash.similarity(bags[x], bags[y]) >= 0.6
            parent[find(x)] = find(y)
        for x in range(20):
            for y in range(x):
                if Fraction(sum((bags[x] & bags[y]).values()), sum((bags[x] | bags[y]).values())) >= Fraction(3, 5):
                    assert find(x) == find(y)


@pytest.mark.parametrize("length", [5, 20, 100, 121])
def test_interval_expansion_finds_repeats(length):
    rng = np.random.default_rng(length)
    base = rng.integers(97, 100, 2500).astype(np.uint8)
    base[1500:1700], base[2300:2420] = base[100:300], base[150:270]
    whole = base.tobytes()
    parts = [whole[:900], whole[900:1600], whole[1600:]]
    windows = np.array([max(0, len(p) - length + 1) for p in parts])
    seen = Counter(p[i : i + length] for p, n in zip(parts, windows, strict=True) for i in range(n))
    for p, n, runs in zip(parts, windows, suffix_dedup.repeated_windows(parts, windows, length), strict=True):
        marks = np.zeros(n, bool)
        for first, size in runs.reshape(-1, 2):
            marks[first : first + size] = True
        assert marks.tolist() == [seen[p[i : i + length]] > 1 for i in range(n)]


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(97, 123, 3000).astype(np.uint8) for _ in range(2))
    b[700:1300] = a[1500:2100]
    left = suffix_dedup.anchors(a, 400)[1500:1701] - 1500
    assert (left == suffix_dedup.anchors(b, 400)[700:901] - 700).all()
    first, windows, _ = suffix_dedup.stretches(a, 400)
    assert windows.sum() == 2601 and (np.cumsum(windows)[:-1] == first[1:]).all()


def test_sentences():
    t = "One two. Three four five! six\nSeven eight nine ten eleven twelve. 13.5 x"
    data, offsets = text.text_bytes(pa.array([t, None, "", "a b"]))
    found = text.words(data, offsets)
    starts = span_dedup.sentence_starts(data, found, 4)
    assert [bytes(data[found.start[s] : found.end[s]]).decode() for s in starts] == ["One", "Three", "six", "Seven", "eleven", "13", "a"]


def test_tile_is_exact():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 24)).astype(np.float32).astype(float)
    x[50] = x[51] = x[7]
    x[60] *= 1e6
    ids = np.arange(300)
    row, at, score = block_search.tile(x[:40], ids[:40], x, ids, 10)
    for q in range(40):
        d = np.sqrt(np.array([sum((a - b) * (a - b) for a, b in zip(x[q], c, strict=True)) for c in x]))
        best = sorted((v, i) for i, v in enumerate(d) if i != q)[:10]
        assert list(zip(score[row == q], at[row == q], strict=True)) == best


def test_trees():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) & (x[:, 3] < 0.5)).astype(float)
    model = quality.fit(x[:1500], y[:1500], trees=30)
    assert ((model.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.97
    one = quality.fit(x[:10], np.ones(10))
    assert (one.score(x[:3]) > 0.9).all()
    assert quality.fit(x[:0], np.zeros(0)).score(x[:2]).tolist() == [0.5, 0.5]


def test_features_of_nothing():
    data, offsets = text.text_bytes(pa.array(["", None, "Aa. b b\nx\nx"]))
    got = quality.features(data, offsets)
    assert got.shape == (3, len(quality.FEATURES)) and not got[:2].any() and np.isfinite(got).all()
    alone = quality.features(*text.text_bytes(pa.array(["Aa. b b\nx\nx"])))
    assert (alone[0] == got[2]).all()


def test_rule_tokens():
    rule = url_filter.SiteRule("example.org", "/en/1", "block")
    assert rule.tokens == ["example", "org", "en"] and rule.name == "example.org/en/1"
    assert url_filter.PatternRule("^spam^farm*", "block").tokens == ["spam"]
    assert re.search(url_filter.quote("a.b/é").replace("\\x{", "\\u{").replace("\\u{2e}", "\\.").replace("\\u{e9}", "é"), "a.b/é")


def test_hash_of_left_bytes():
    data = pa.RecordBatch.from_pydict({
        "text": pa.array(["abcdef", None]), "spans": pa.array([[{"first": 1, "size": 2}, {"first": 2, "size": 2}], None], pa.list_(pa.struct([("first", pa.int32()), ("size", pa.int32())]))), "doc_id": [1, 2],
    })
    out = next(suffix_dedup._cut(["doc_id"], iter([data]))).to_pylist()
    assert out[0]["kept"] == b"aef" and out[0]["spans"] == [{"start": 1, "end": 4}] and out[1]["kept"] == b"" and out[1]["n_bytes"] == 0
