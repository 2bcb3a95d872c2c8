"""Codebooks, mixing and conversation repair on small awkward tables, against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatloom.llm import codebooks, conversations, mixing
from heatloom.llm.conversations import ANSWERED, BEGINNING, BLANK, CUT_OFF, DUPLICATE, EMPTY, FINE


# ---- vector codes ----


def brute_codes(rows, parts, entries, rounds):
    """rows: (vec_id, whole numbers), sorted. Codes and errors by comparing every part with every entry."""
    x = np.array([w for _, w in rows], object).reshape(len(rows), parts, -1)
    books = [[list(x[i, p]) for i in range(min(entries, len(rows)))] for p in range(parts)]
    far = lambda a, b: sum((u - v) ** 2 for u, v in zip(a, b, strict=True))
    find = lambda: [[min(range(len(books[p])), key=lambda e: (far(x[i, p], books[p][e]), e)) for p in range(parts)] for i in range(len(rows))]
    for _ in range(rounds):
        codes = find()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [x[i, p] for i in range(len(rows)) if codes[i][p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    codes = find()
    errors = [sum(far(x[i, p], books[p][codes[i][p]]) for p in range(parts)) for i in range(len(rows))]
    whole = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    return ["".join(f"{e:02x}" for e in c) for c in codes], errors, whole


@pytest.mark.parametrize("spread", [0.01, 1.0, 500.0])
def test_orchard_finds_the_nearest(spread):
    rng = np.random.default_rng(3)
    books = codebooks.Codebooks.of(codebooks.whole_numbers(rng.normal(0, spread, (4, 32, 3))))
    x = codebooks.whole_numbers(rng.normal(0, spread, (500, 4, 3)))
    code, error, measured = books.search(x)
    every = ((x[:, :, None, :] - books.entries[None]) ** 2).sum(3)
    assert (error == every.min(2)).all() and (code == every.argmin(2)).all()
    if spread > 0.1:
        assert measured < 0.7 * every.size  # most distances are never measured


def test_orchard_with_equal_entries():
    entries = np.zeros((1, 9, 2), np.int64)
    entries[0, 4:] = 5
    code, error, _ = codebooks.Codebooks.of(entries).search(np.array([[[0, 0]], [[5, 5]], [[9, 9]], [[2, 3]]]))
    assert code.ravel().tolist() == [0, 4, 4, 0] and error.ravel().tolist() == [0, 0, 32, 13]


def test_codes_of_awkward_vectors(spark):
    rng = random.Random(5)
    good = [(k, k % 3 if k % 4 else None, [rng.uniform(-1, 1) for _ in range(8)]) for k in range(40)]
    good += [(3, 7, good[3][2]), (3, 7, good[3][2]), (40, 1, [0.0] * 8), (41, 1, [1e30, -1e30] + [0.5] * 6), (None, 2, [0.25] * 8)]
    odd = [(50, 1, None), (51, 1, [None] + [0.0] * 7), (52, 1, [float("nan")] * 8), (53, 1, [float("inf")] * 8)]
    other = [(60, 1, [1.0] * 6), (61, 1, [])]
    df = spark.createDataFrame([(*r, "x", "y") for r in good + odd + other], "vec_id long, label int, vector array<double>, code string, error string").repartition(4)
    rows = codebooks.compress(df, parts=4, entries=6).collect()
    assert len(rows) == len(good) + len(other) and list(rows[0].asDict()) == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert all(r["code"] is None and r["error"] is None for r in rows if r["vec_id"] in (60, 61))
    whole = sorted(((i, codebooks.whole_numbers(np.array(v)).tolist()) for i, _, v in good), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    codes, errors, digest = brute_codes(whole, 4, 6, 2)
    found = sorted(((r["vec_id"], r["code"], r["error"]) for r in rows if r["code"]), key=repr)
    assert found == sorted(((i, c, e) for (i, _), c, e in zip(whole, codes, errors, strict=True)), key=repr)
    assert {r["codebooks_sha256"] for r in rows} == {digest}
    sums = {}
    for r in rows:
        sums[r["label"]] = sums.get(r["label"], 0) + (r["error"] or 0)
    assert all(r["label_error"] == sums[r["label"]] for r in rows)
    assert codebooks.compress(df.where("false"), parts=4, entries=6).count() == 0
    assert codebooks.compress(df.where("vec_id > 59"), parts=4, entries=6).select("code").distinct().collect() == [(None,)]


# ---- mixing ----


def test_mix_of_awkward_documents(spark):
    rows = [(k, f"s{k % 4}" if k % 9 else None, "word " * (k * k % 400 + 1), 9) for k in range(400)]
    rows += [(k, "s1", "many words " * 3000, 9) for k in (1000, 1001)]
    rows += [(5, "s2", "repeated row here", 9)] * 30 + [(None, "s3", "no id", 9), (None, "s3", None, 9), (None, None, "  \n\t ", 9), (7, "blank", " ", 9), (8, "small", "two words", 9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, size long")
    got = mixing.mix(df.repartition(3)).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    total = sum(len((t or "").split()) for _, _, t, _ in rows)
    size = {}
    for _, s, t, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    stopped = set()
    while True:
        left, w = total - sum(3 * size[s] for s in stopped), sum(weight[s] for s in names if s not in stopped)
        more = {s for s in names if s not in stopped and left * weight[s] / w > 3 * size[s]}
        if not more:
            break
        stopped |= more
    target = {s: 3 * size[s] if s in stopped else left * weight[s] / w for s in names}
    assert {"blank", "small"} <= stopped and sum(target.values()) == pytest.approx(total)
    of = {(r["doc_id"], r["size"]): r for r in got}
    assert all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in got)
    taken = dict.fromkeys(names, 0)
    for i, s, t, _ in rows:
        r = of[(i, len((t or "").split()))]
        if not r["size"]:
            assert r["taken"] == 0  # two rows of null id and no words, of two sources
            continue
        assert r["source_size"] == size[s] and r["target"] == pytest.approx(target[s])
        taken[s] += r["taken"]
    for s in names:
        assert abs(taken[s] - target[s]) <= max(3, 0.02 * target[s])
    assert mixing.mix(df.where("false")).count() == 0


def test_mix_follows_inclusion_odds(spark):
    """Documents of a higher grade are taken more often, in the ratio of the grades."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one").alias("source"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 2 == 0, 3).otherwise(1).alias("grade"))
    df = df.unionByName(spark.range(4000, 4100).select(F.col("id").alias("doc_id"), F.lit("two").alias("source"), F.lit("e " * 200).alias("text"), F.lit(1).alias("grade")))
    rows = mixing.mix(df, weights=(1, 3), preference=F.col("grade")).where("doc_id < 4000").select("doc_id", "copies", "target").collect()
    high, low = (sum(r["copies"] for r in rows if r["doc_id"] % 2 == k) for k in (0, 1))
    assert abs(4 * (high + low) - rows[0]["target"]) <= 4
    assert 2.7 < high / low < 3.3
    other = mixing.mix(df, weights=(1, 3), preference=F.col("grade"), seed=1).where("doc_id < 4000 and copies > 0").select("doc_id").collect()
    assert {r["doc_id"] for r in rows if r["copies"]} != {r["doc_id"] for r in other}


# ---- conversations ----


def brute_repair(rows):
    """rows: (initial, forced, late). The cheapest edits by trying all, ties to the least string."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    best = {"": (0, "")}

    def put(out, state, way):
        if state not in out or way < out[state]:
            out[state] = way

    def insert(front):
        for _ in range(4):
            out = dict(front)
            for (before, letter), after in step.items():
                if before in front and letter != "s":
                    put(out, after, (front[before][0] + 2, front[before][1] + "I"))
            front = out
        return front

    best = insert(best)
    for initial, forced, late in rows:
        out = {}
        for state, (cost, edits) in best.items():
            put(out, state, (cost + 3, edits + "D"))
            for letter in "" if forced else "sua":
                if (state, letter) in step and letter == initial:
                    put(out, step[state, letter], (cost + late, edits + "K"))
                elif (state, letter) in step and letter != "s":
                    put(out, step[state, letter], (cost + late + 2, edits + "R"))
        best = insert(out)
    return min(best[s] for s in ("", "a") if s in best)


def searched(symbols, limit, cuts=()):
    pieces, stretch = [], conversations.Stretch((BEGINNING,), limit)
    for k, (initial, fault) in enumerate(symbols):
        if k in cuts:
            pieces += stretch.end()
            stretch = conversations.Stretch(conversations.ANY, limit)
        stretch.row(initial, fault, 1)
    return conversations.compose(pieces + stretch.end())


def test_search_equals_brute_force():
    rng = random.Random(1)
    cases = [list(c) for n in range(1, 5) for c in itertools.product([("u", FINE), ("a", FINE), ("s", CUT_OFF), ("x", FINE)], repeat=n)]
    cases += [[(rng.choice("uuaasx"), rng.choice([FINE, FINE, FINE, BLANK, DUPLICATE, CUT_OFF])) for _ in range(rng.randint(1, 60))] for _ in range(300)]
    for case in cases:
        expected = brute_repair([(i, f in (BLANK, DUPLICATE), f == CUT_OFF) for i, f in case])
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in itertools.pairwise(case))
        assert searched(case, 1 << 20) == (*expected, illegal)
        cuts = {k for k in range(1, len(case)) if rng.random() < 0.2}
        assert searched(case, rng.choice([30, 1 << 20]), cuts) == (*expected, illegal)


def test_edits_compare_like_strings(monkeypatch):
    for base in (conversations._BASE, 0):  # with 0 all lists of one last edit collide
        monkeypatch.setattr(conversations, "_BASE", base)
        rng, edits = random.Random(2), conversations.Edits()
        nodes = [0]
        for _ in range(600):
            nodes.append(edits.add(rng.choice(nodes[-9:]), rng.choice("DK")))
        for _ in range(4000):
            a, b = rng.choice(nodes), rng.choice(nodes)
            assert edits.less(a, b) == (edits.text(a) < edits.text(b))
        a = rng.choice(nodes)
        assert edits.text(edits.at(a, edits.size[a] // 2)) == edits.text(a)[: edits.size[a] // 2]


def brute_conversations(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, t, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
            own += [(t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in own:
            v = text.rstrip(" \t\n\v\f\r")
            faults.append(BLANK if not v else DUPLICATE if (role, text) in seen else FINE if v[-1] in ".!?" else CUT_OFF)
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        cost, audit = brute_repair([(r[:1], f in (BLANK, DUPLICATE), f == CUT_OFF) for (_, r, _), f in zip(own, faults, strict=True)]) if own else (0, "")
        lines, at, state = [], 0, ""
        for edit in audit:
            wanted = "assistant" if state == "u" else "user"
            if edit != "I":
                (_, role, text), at = own[at], at + 1
            if edit == "D":
                continue
            line = (role, text) if edit == "K" else (wanted, text if edit == "R" else "")
            lines.append(":".join(line))
            state = line[0][:1]
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(own)]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in (BLANK, DUPLICATE, CUT_OFF)), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("limit", [40, conversations.NODES])
def test_repair_of_awkward_conversations(spark, monkeypatch, limit):
    rng = random.Random(8)
    texts = ["Yes.", "No!", "why", "", " \t\n", None, "é 中文?", "a " * 3000, "ends. \x0b\x0c", "x" * 20000]
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", None, "", "tool"]), rng.choice(texts)) for c in range(25) for t in range(rng.randint(1, 12))]
    # One conversation holds most rows, of which many are equal or have no turn.
    rows += [(77, None if k % 50 == 0 else k // 2, ("user", "assistant")[k % 3 % 2], f"row {k % 90}." if k % 4 else "same.") for k in range(900)]
    rows += [(77, 3, "user", "equal rows")] * 200 + [(None, 2, "user", "no id?"), (None, None, None, None), (-5, -(1 << 62), "user", "far"), (-5, 1 << 62, "assistant", "away.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost long")
    real = conversations.NODES
    monkeypatch.setattr(conversations, "NODES", limit)
    monkeypatch.setattr(conversations.repair, "__defaults__", (limit,))
    got = {r["conv_id"]: tuple(r)[1:] for r in conversations.repair_damaged(df.repartition(5)).collect()}
    assert real >= limit and got == {c: v if abs(v[0]) < 1 << 63 else (None, *v[1:]) for c, v in brute_conversations(rows).items()}
    assert conversations.repair_damaged(df.where("false")).count() == 0


def test_states_are_the_wanted_pattern():
    assert conversations.STEP["u"] == {EMPTY: conversations.OPEN, conversations.SYSTEM: conversations.OPEN, ANSWERED: conversations.OPEN}
