"""The corpus operators on small tables with awkward rows, and their queries against SQL or brute force."""

import hashlib
import math
import zlib
from array import array
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
import corpus_pipeline
from heatloom.llm import bag_minhash, block_search, decontaminate, graph, packing, piece_counts, quality, queries, records, span_dedup, suffix_dedup, tokens, url_filter
from heatloom.session import scratch_path
from tests.llm.test_kernels import plain_words

TABLES = "documents embeddings pages benchmark labels conversations".split()
LONG = " ".join(f"word{k % 977} of{k % 13}" for k in range(30_000))
PASSAGE = "The quick brown fox jumps over the lazy dog today. It then sleeps for a very long while under trees. Nobody knows how it came to be so tired at all. " * 1
PASSAGE += "But the old man by the river has seen it before. He smiles and says nothing when the children ask him why. Then the evening comes and all go home."


def awkward(spark, texts):
    """Documents with extra columns of clashing names; ids count from 0, the last two rows share one."""
    rows = [(k, t, "x", 1.5, "y") for k, t in enumerate(texts)]
    rows.append((len(texts), "same", "x", 1.0, "y"))
    rows.append((len(texts), "same", "x", 1.0, "y"))
    rows.append((None, "an orphan text of some seven words", "x", 1.0, "y"))
    return spark.createDataFrame(rows, "doc_id long, text string, key string, score double, bag string")


TEXTS = [None, "", "   \n ", "one", "two words", LONG, LONG, LONG + " end", PASSAGE, "Before it. " + PASSAGE + " After it all.", "ÄÖ ß 中文 😀, a<b>c"]


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark, TEXTS).repartition(3).cache()


def plain(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def got(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_records_round_trip(spark, docs):
    files = records.write_records(docs, scratch_path(spark, "records"))
    encode = tokens.encoder(tokens.default_tokenizer())
    expected = [(i, encode(t) + array("I", [2]).tobytes()) for i, t in sorted(plain(docs), key=lambda r: (r[0] is not None, r[0] or 0))]
    assert got(records.read_records(files), "doc_id", "ids") == sorted([(i, bytearray(x)) for i, x in expected], key=repr)
    shuffled = records.read_shuffled(files, 7)
    assert got(shuffled, "doc_id", "ids") == got(records.read_records(files), "doc_id", "ids")
    assert [r["doc_id"] for r in shuffled.collect()] == [r["doc_id"] for r in records.read_shuffled(files, 7).collect()]
    rows = sorted(records.digest(files).collect(), key=lambda r: (r["doc_id"] is not None, r["start"]))
    at = 0
    for r, (i, x) in zip(rows, expected, strict=True):
        assert (r["doc_id"], r["n_tokens"]) == (i, len(x) // 4) and r["start"] == at
        at += r["n_tokens"]
    assert Counter(r["ids_crc32"] for r in rows) == Counter(zlib.crc32(x) for _, x in expected)


def test_packing_places_every_piece(spark, docs):
    rows = packing.pack_documents(docs, room=64).collect()
    encode = tokens.encoder(tokens.default_tokenizer())
    for i, t in plain(docs):
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        ids = encode(t) + array("I", [2]).tobytes()
        copies = len([1 for j, _ in plain(docs) if j == i])
        assert sum(r["length"] for r in own) == copies * len(ids) // 4
        assert all(r["ids_crc32"] == zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) for r in own)
        assert all(r["length"] == 64 for r in own if r["piece"])
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= math.ceil(sum(r["length"] for r in rows) / 64) + 2


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://a.org", "http://a.org/", "HTTP://A.Example.ORG:80/es/x?y#z", "x://example.org/en/12", "x://notexample.org/en/1", "http://b.com/fr/a", "http://b.com/FR/a",
            "http://com/de/", "http://free-bets.net/x", "http://anti-spam.net/", "http://spam.net", "http://x.net/a?casino", "a://b.net/q://c.org/", "http://é.net/ü\nx", "http://x.net/" + "a/" * 5000]
    pages = spark.createDataFrame([(k, u, "h", "r") for k, u in enumerate([*urls, "http://a.org/"])] + [(0, None, "h", "r")], "page_id long, url string, host string, rule string")
    rows = {r["page_id"]: r for r in url_filter.judge_urls(pages).collect()}
    assert url_filter.judge_urls(pages).count() == len(urls) + 2
    view = {k: (r["host"], r["path"], r["rule"], r["verdict"]) for k, r in rows.items()}
    assert view[0] == view[1] == view[2] == view[3] == ("", "", None, "allow")
    assert view[4] == ("a.org", "", None, "allow") and view[5] == ("a.org", "/", "org/", "allow")
    assert view[6] == ("a.example.org:80", "/es/x", None, "allow") and view[7] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert view[8][2:] == ("org/", "allow") and view[9][2:] == ("com/fr/", "allow") and view[10][2:] == (None, "allow") and view[11][2:] == ("com/de/", "block")
    assert [view[k][3] for k in (12, 13, 14, 15)] == ["block", "allow", "block", "allow"]
    assert view[16][:2] == ("b.net", "/q://c.org/") and view[17][:2] == ("é.net", "/ü\nx")
    assert url_filter.judge_urls(pages.where("false")).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge_urls(pages, patterns=[url_filter.PatternRule("*spam*", "block")])


def test_url_plan_is_native(spark):
    plan = url_filter.judge_urls(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"))._jdf.queryExecution().executedPlan().toString()
    assert not [n for n in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop") if n in plan]


def brute_repeats(rows, length):
    seen = Counter(b[i : i + length] for _, b in rows for i in range(len(b) - length + 1))
    out = []
    for i, b in rows:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1])), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_dedup(spark, docs):
    short = awkward(spark, [t[:4000] if t else t for t in TEXTS] + ["ab" * 900, "x" + "ab" * 700, "a" * 399, "a" * 400, "z" + "é" * 300 + "y" * 399])
    for df in (short, short.where("doc_id = 9"), short.where("false")):
        rows = [(i, (t or "").encode()) for i, t in plain(df)]
        assert got(suffix_dedup.digest(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, 400)
    assert suffix_dedup.remove_repeats(docs).count() == docs.count()


def test_suffix_dedup_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4000)  # many blocks of one anchor
    passage = "".join(chr(97 + (k * k * 7 + k // 3) % 26) for k in range(700))
    df = spark.createDataFrame([(k, f"{k * 7919:020d}" * 9 + passage + f"{k * 104729:020d}" * 9) for k in range(40)], "doc_id long, text string")
    rows = [(i, t.encode()) for i, t in plain(df)]
    assert got(suffix_dedup.digest(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, 400)


def brute_groups(rows):
    bags = []
    for _, t in rows:
        w = plain_words(t)
        k = min(5, len(w))
        bags.append(Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else None)
    label = list(range(len(rows)))
    for x in range(len(rows)):
        for y in range(x):
            if bags[x] and bags[y] and 5 * sum((bags[x] & bags[y]).values()) >= 4 * sum((bags[x] | bags[y]).values()):
                a, b = label[x], label[y]
                label = [b if v == a else v for v in label]
    return label


def test_near_duplicates(spark, docs):
    base = [f"w{k * k % 991}" for k in range(300)]
    near = []
    for k in range(30):
        own = list(base)
        for j in range(k % 5):
            own[(k * 37 + j * 61) % 300] = f"new{k}"
        near.append(" ".join(own))
    df = awkward(spark, TEXTS[:5] + TEXTS[8:] + near + ["a b c d e", "a b c d e.", "A, b c d E f"])
    rows = sorted(plain(df), key=repr)
    label = brute_groups(rows)
    want = Counter(frozenset(Counter(rows[k][0] for k in range(len(rows)) if label[k] == v).items()) for v in set(label))
    found = {}
    for r in bag_minhash.near_groups(df).collect():
        found.setdefault(r["group"] if r["group"] is not None else f"alone {r['id']}", []).append(r["id"])
    assert Counter(frozenset(Counter(v).items()) for v in found.values()) == want
    kept = bag_minhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(set(label))
    digest = bag_minhash.near_duplicates(df).collect()
    assert len(digest) == len(rows) and {r["group_size"] for r in digest if r["doc_id"] == 0} == {1}
    assert bag_minhash.near_duplicates(df.where("false")).count() == bag_minhash.keep_one(df.where("false")).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(1, 1), (7, 8), (8, 7), (-3, 8)]
    found = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[k] for k in range(100, 161)} == {100} and {found[k] for k in range(200, 260)} == {5} == {found[5]}
    assert found[7] == found[8] == found[-3] == -3 and 1 not in found


def test_block_search(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(k, [float((k * 7 + j * j) % 11 + 1), float(k % 5), float(j)]) for k, j in ((k, k % 3) for k in range(230))]
    odd = [(300, None), (400, []), (500, [0.0, 0.0, 0.0]), (600, [nan, 1.0, 1.0]), (700, [1.0, None, 2.0]), (800, [inf, 1.0, 1.0]), (900, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (200, vectors[200][1])]
    df = spark.createDataFrame([(*r, 1, "s") for r in vectors + odd], "vec_id long, embedding array<float>, rank int, score string")
    rows = got(block_search.nearest(df.select("vec_id", F.col("embedding").alias("vector")), df.where("vec_id % 100 = 0").select("vec_id", F.col("embedding").alias("vector")), 10, 2, 50), "query_id", "rank", "vec_id", "score")
    expected = []
    for q in (0, 100, 200):
        d = sorted((math.sqrt(sum((a - b) * (a - b) for a, b in zip(vectors[q][1], v, strict=True))), i) for i, v in vectors if i != q)
        expected += [(q, k + 1, i, s) for k, (s, i) in enumerate(d[:10])]
    assert rows == sorted(expected, key=repr)
    assert block_search.search(df.where("false")).count() == 0
    assert block_search.search(df.where("vec_id = 100")).count() == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(9)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows)
    assert quality.classify(docs, labels.where("false")).count() == docs.count()
    assert quality.classify(docs.where("false"), labels).count() == 0


def test_held_out_quality(spark, data):
    documents, labels = (spark.read.parquet(f"{data.rsplit('/', 1)[0]}/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.classify(documents, labels).where("held_out").join(labels, "doc_id").where("quality is not null").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)


def test_piece_counts(spark, docs):
    begin, go_on = map(set, piece_counts.byte_level_pieces(tokens.default_tokenizer()))
    longest = max(map(len, begin | go_on))

    def greedy(word):
        n = at = 0
        while at < len(word):
            size = next((k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in (go_on if at else begin)), 0)
            if not size:
                return None
            at, n = at + size, n + 1
        return n

    rows = {r["doc_id"]: r for r in piece_counts.piece_counts(docs, block=1000).collect()}
    import re

    for i, t in plain(docs):
        if t is not LONG:
            words = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]", (t or "").encode())
            counts = [greedy(w) for w in words]
            assert (rows[i]["n_words"], rows[i]["n_pieces"], rows[i]["n_unknown"]) == (len(words), sum(c or 1 for c in counts), counts.count(None))
    assert piece_counts.piece_counts(docs.where("false")).count() == 0


def test_span_dedup(spark, docs):
    out = {(r["doc_id"], i): r for i, r in enumerate(span_dedup.drop_repeated_sentences(docs).orderBy("doc_id").collect())}
    by = {k[0]: r for k, r in out.items()}
    texts = dict(plain(docs))
    assert len(out) == docs.count() and by[0]["text"] is None and by[1]["text"] == "" and by[2]["text"] == "   \n "
    # Equal 12-word cuts of one unpunctuated text: the copy goes, the first stays but for what it repeats itself.
    assert by[6]["n_removed"] >= by[6]["n_sentences"] - 1 and by[5]["n_removed"] < by[5]["n_sentences"]
    assert by[8]["n_removed"] == 0 and by[8]["text"] == texts[8] and by[9]["n_removed"] >= 6
    assert "quick brown" not in by[9]["text"] and "After it all" in by[9]["text"] and by[9]["text"].startswith("Before it.")
    assert by[11]["text"] == "same" and by[None]["n_removed"] == 0
    assert {"key", "score", "bag"} <= set(span_dedup.drop_repeated_sentences(docs).columns)
    kept = span_dedup.dedupe_spans(docs)
    assert kept.columns == docs.columns and 0 in {r["doc_id"] for r in kept.collect()}
    assert span_dedup.drop_repeated_sentences(docs.where("false")).count() == 0


def brute_contamination(rows, items, window=13):
    out = []
    grams = {}
    for i, t in items:
        w = plain_words(t)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if w else 0):
            grams.setdefault(tuple(w[j : j + k]), set()).add("null" if i is None else str(i))
    sizes = {len(g) for g in grams}
    for i, t in rows:
        w, hit, named = plain_words(t), set(), set()
        for k in sizes:
            for j in range(len(w) - k + 1):
                if (g := tuple(w[j : j + k])) in grams:
                    hit |= set(range(j, j + k))
                    named |= grams[g]
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_decontamination(spark, docs):
    w = PASSAGE.split()
    items = [(1, " ".join(w[5:30])), (2, " ".join(w[5:30])), (3, "one"), (4, "two WORDS"), (5, None), (6, ""), (None, " ".join(w[20:40])), (7, " ".join(w[:12])), (8, " ".join(w[3:16])), (8, "unseen words only")]
    items.append((9, " ".join(f"word{k % 977} of{k % 13}" for k in range(500, 540))))
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, key int")
    for df, b in ((docs, benchmark), (docs.where("false"), benchmark), (docs, benchmark.where("false")), (docs, benchmark.where("item_id = 3"))):
        found = got(decontaminate.contamination(df, b), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
        assert found == brute_contamination(plain(df), [(r["item_id"], r["text"]) for r in b.collect()])
    kept = decontaminate.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(not r[-1] for r in brute_contamination(plain(docs), items))


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, data, name):
    df = queries.QUERIES[name](spark, data)
    cursor = duck.execute(queries.SQL[name])
    columns = sorted(c[0] for c in cursor.description)
    assert sorted(df.columns) == columns
    at = [[c[0] for c in cursor.description].index(n) for n in columns]
    assert got(df, *columns) == sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)


def test_queries_equal_brute_force(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    rows = plain(documents)
    assert got(queries.QUERIES["op3_suffix_dedup"](spark, data), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats([(i, (t or "").encode()) for i, t in rows], 400)
    label = brute_groups(rows)
    heads = {v: min(rows[k][0] for k in range(len(rows)) if label[k] == v) for v in set(label)}
    assert got(queries.QUERIES["op4_bag_minhash"](spark, data), "doc_id", "group_id") == sorted(((r[0], heads[v]) for r, v in zip(rows, label, strict=True)), key=repr)


def test_entry_registers_all():
    names = entry_module.queries()
    assert {f"op{k}" for k in range(1, 14)} == {n.split("_")[0] for n in queries.QUERIES} and set(queries.QUERIES) < set(names) and "pipeline" in names


def test_pipeline(spark, data):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = plain(docs)
        after = stage(spark, docs, data)
        if name == "near_dedup":
            assert after.count() == len(set(brute_groups(before)))
        if name == "benchmark_decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            assert {r[0] for r in plain(after)} == {r[0] for r in brute_contamination(before, items) if not r[-1]}
        if name != "best_fit_packing":
            assert after.columns == docs.columns
            docs = after.cache()
    assert list(stages)[0] == "quality_classifier" and corpus_pipeline.run(spark, data).agg(F.sum("length")).first()[0] > 0
