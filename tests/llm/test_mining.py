"""Packing, phrase mining and hard negatives against brute force."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest

from cuegrain.llm import best_fit_packing as packing
from cuegrain.llm import hard_negatives as mining
from cuegrain.llm import phrase_mining as phrases

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- packing


def fewest(lengths, capacity):
    """The least number of sequences, by trying all."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for r in {r for r in rooms if r >= lengths[i]}:
            at = rooms.index(r)
            place(i + 1, [*rooms[:at], r - lengths[i], *rooms[at + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


def check_solution(counts, capacity, solution):
    held = [0] * (capacity + 1)
    for pattern, times in solution:
        assert sum(x * m for x, m in pattern) <= capacity and times > 0
        for x, m in pattern:
            held[x] += m * times
    assert held == list(counts)


@pytest.mark.parametrize("low,high,n", [(1, 20, 14), (5, 12, 12), (6, 14, 11), (3, 9, 13)])
def test_completion_finds_the_fewest_sequences(low, high, n):
    rnd = random.Random(low * high)
    for _ in range(40):
        lengths = [rnd.randint(low, high) for _ in range(n)]
        counts = np.bincount(lengths, minlength=21)
        solution = packing.bin_completion(counts, 20)
        check_solution(counts, 20, solution)
        assert sum(k for _, k in solution) == fewest(lengths, 20)


def test_completion_beats_best_fit():
    lengths = [6, 5, 5, 4, 4, 3, 3]  # best fit opens a fourth sequence of 10
    counts = np.bincount([*lengths, 0], minlength=11)
    counts[0] = 0
    assert sum(k for _, k in packing.best_fit([int(x) for x in counts], 10)) >= 3
    assert sum(k for _, k in packing.bin_completion(counts, 10)) == fewest(lengths, 10) == 3
    rnd, better = random.Random(3), 0
    for _ in range(200):
        counts = np.bincount([rnd.randint(6, 20) for _ in range(30)], minlength=51)
        fit = sum(k for _, k in packing.best_fit([int(x) for x in counts], 50))
        found = packing.bin_completion(counts, 50, 2000)
        check_solution(counts, 50, found)
        n = sum(k for _, k in found)
        assert packing.lower_bound(counts, 50) <= n <= fit
        better += n < fit
    assert better


def test_bound_holds_for_many_equal_pieces():
    counts = np.zeros(4097, np.int64)
    counts[4096], counts[2049], counts[2047], counts[1] = 10**12, 10**11, 10**11, 5
    solution = packing.bin_completion(counts, 4096)
    check_solution(counts, 4096, solution)
    assert sum(k for _, k in solution) == 10**12 + 10**11 + 1


ODD = [
    "Don't stop, won't! a.b -. x..- ÉCOLE école İstanbul ΣΑΣ 12,5 áb Á nb sp em\t\n\x0b\x0c\x1c\x1d end.",
    "<|endoftext|> a <|startoftext|>b", "<|ENDOFTEXT|> x", "", "   ", "a\x00b ... ,. !?", "日本語 text。 ﬁne ½ ² Ⅷ ª º", "x" * 5000 + " y", "it's 'sup 's WE'LL don't.", "é, É. ñ: ß? ǅ ǆ", "word. word, word word.", "́a á. Å",
]


def test_ids_are_the_librarys():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(MODEL)
    mine = packing.WordIds(MODEL)
    rnd = random.Random(7)
    made = ["".join(rnd.choice("aAbB .,'-é\n\t1ßİ") for _ in range(60)) for _ in range(300)]
    for text in ODD + made:
        assert np.frombuffer(mine.of(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_slices_and_forgotten_words_change_nothing(monkeypatch):
    text = " ".join(ODD[:1] + ODD[3:]) * 3
    want = packing.WordIds(MODEL).of(text)
    monkeypatch.setattr(packing, "SLICE", 16)
    monkeypatch.setattr(packing, "MEMO", 2)
    assert packing.WordIds(MODEL).of(text) == want


def brute_pieces(rows, capacity):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(MODEL)
    out = []
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        for n, lo in enumerate(range(0, len(ids), capacity)):
            cut = ids[lo : lo + capacity]
            out.append((i, n, lo, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    return sorted(out, key=str)


def test_pack_documents(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["the", "cat", "sat", "Überall", "x1"]) for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    rows += [(7, "twice"), (7, "twice"), (None, "no id"), (301, None), (302, ""), (303, "long " * 9000), *((i, t) for i, t in enumerate(ODD, 400))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS ids", "1 AS piece", "2 AS length", "3L AS offset", "4L AS sequence_id")
    cut = packing.pieces(df.repartition(5), MODEL, 64)
    packed = packing.pack(cut, 64)
    got = packed.collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, zlib.crc32(r.ids)) for r in got), key=str) == brute_pieces(rows, 64)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    lengths = np.bincount([r.length for r in got], minlength=65)
    assert len(by) == sum(k for _, k in packing.bin_completion(lengths, 64)) <= packing.lower_bound(lengths, 64) + 1
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert whole == {k: b"".join(bytes(r.ids) for r in sorted(v, key=lambda r: r.offset)) for k, v in by.items()}


def test_pack_nothing_and_wrong_lengths(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(packing.pieces(empty, MODEL)).collect() == []
    with pytest.raises(ValueError, match="length"):
        packing.pack(spark.createDataFrame([(1, 65)], "doc_id long, length long"), 64)


def test_packing_does_not_lose_hot_lengths(spark):
    df = spark.range(0, 6000, 1, 7).selectExpr("id AS doc_id", "CAST(CASE WHEN id % 3 = 0 THEN 40 ELSE id % 25 + 1 END AS long) AS length")
    got = packing.pack(df, 64).groupBy("sequence_id").agg({"length": "sum", "doc_id": "count"}).collect()
    assert sum(r["count(doc_id)"] for r in got) == 6000
    assert max(r["sum(length)"] for r in got) <= 64
    lengths = np.bincount([40 if i % 3 == 0 else i % 25 + 1 for i in range(6000)], minlength=65)
    assert len(got) == sum(k for _, k in packing.bin_completion(lengths, 64)) <= 1.01 * packing.lower_bound(lengths, 64)


# ---------------------------------------------------------------- phrases


def brute_phrases(rows, least, longest=4, contained=80, top=2000):
    out = []
    by = {}
    for text, lang in rows:
        by.setdefault("und" if lang is None else lang, []).append((text or "").translate({i: i + 32 for i in range(65, 91)}))
    for lang, texts in by.items():
        f, n = {}, 0
        for text in texts:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
                words = re.findall(r"[^\x20\x09]+", piece)
                n += len(words)
                for k in range(1, longest + 1):
                    for i in range(len(words) - k + 1):
                        g = tuple(words[i : i + k])
                        f[g] = f.get(g, 0) + 1
        frequent = [g for g in f if 2 <= len(g) and f[g] >= least]
        rows_ = []
        for g in frequent:
            if any(100 * f[h] >= contained * f[g] for h in frequent if len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h) - len(g) + 1))):
                continue
            score, k = min((2_000_000 * f[g] // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g)))
            rows_.append((score, f[g], " ".join(g), f[g[:k]], f[g[k:]]))
        rows_.sort(key=lambda r: (-r[0], -r[1], r[2].encode()))
        out += [(lang, i, p, a, l, r, n, s) for i, (s, a, p, l, r) in enumerate(rows_[:top], 1)]
    return sorted(out)


def made_texts(seed, n):
    rnd = random.Random(seed)
    vocabulary = [*"abcdefgh", "né", "Zz", "ab", "x" * 70, "don't", " "]
    made = []
    for _ in range(n):
        words = []
        for _ in range(rnd.randint(0, 30)):
            words += rnd.choice([["new", "York", "city"], ["a", "b", "a", "b"], [rnd.choice(vocabulary)], [rnd.choice(vocabulary)]])
        text = "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ; ", "\x0b"]) for w in words)
        made.append((rnd.choice(["  ", "", "!"]) + text, rnd.choice(["en", "en", "fr", None, "und", "x\ny", ""])))
    return made


@pytest.mark.parametrize("seed", [1, 2])
def test_phrases(spark, seed):
    rows = made_texts(seed, 300) + [(None, "en"), ("", "de"), (None, None), ("a b " * 20000, "fr")]
    df = spark.createDataFrame(rows, "text string, lang string").selectExpr("*", "1 AS phrase", "2 AS f", "'k' AS key", "3 AS n").repartition(4)
    got = phrases.mine_phrases(df, least=5)
    assert sorted(map(tuple, got.collect())) == brute_phrases(rows, 5)


def test_phrases_when_the_map_is_full_and_hashes_meet(spark, monkeypatch):
    rows = made_texts(3, 60)
    monkeypatch.setattr(phrases, "MEMTABLE", 300)
    monkeypatch.setattr(phrases, "FILTER", 32768)
    df = spark.createDataFrame(rows, "text string, lang string")
    assert sorted(map(tuple, phrases.mine_phrases(df, least=4, top=15).collect())) == brute_phrases(rows, 4, top=15)


def test_equal_hashes_are_told_apart_by_bytes():
    words = ["ab", "ab", "cd", "ab", "abcdefghij", "abcdefghik", "cd", "abcdefghij"]
    buf = np.frombuffer((" ".join(words) + " ").encode() + bytes(8), np.uint8)
    size = np.array([len(w) for w in words])
    start = np.cumsum(size + 1) - size - 1
    found = {}
    for one, count in phrases._counted(buf, start, size, np.zeros(len(words), np.uint64)):
        for i, c in zip(one, count, strict=True):
            assert words[i] not in found
            found[words[i]] = int(c)
    assert found == {w: words.count(w) for w in words}


def test_no_phrases(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert phrases.mine_phrases(df).collect() == []
    assert phrases.mine_phrases(spark.createDataFrame([("one two", "en")], "text string, lang string")).collect() == []


# ---------------------------------------------------------------- hard negatives


def brute_negatives(rows, positives=5, negatives=3):
    kept = [(i, label, [int(np.floor(256 * np.float64(x))) for x in v]) for i, v, label in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda j, s: (-s, 2**63 if kept[j][0] is None else kept[j][0])
    out = []
    for a, (anchor, label, v) in enumerate(kept):
        if anchor is None or anchor % 50:
            continue
        score = [sum(x * y for x, y in zip(v, w, strict=False)) for _, _, w in kept]
        same = sorted((j for j in range(len(kept)) if j != a and kept[j][1] == label), key=lambda j: order(j, score[j]))[:positives]
        other = sorted((j for j in range(len(kept)) if kept[j][1] != label), key=lambda j: order(j, score[j]))
        for p in same:
            window = [j for j in other if 50 * score[p] <= 100 * score[j] <= 95 * score[p]][:negatives]
            out += [(anchor, kept[p][0], n, kept[j][0], score[p], score[j]) for n, j in enumerate(window, 1)]
    return sorted(out, key=str)


VECTORS = "vec_id bigint, embedding array<float>, label int"


def made_vectors(seed, n, dims=6, copies=0):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(4, dims))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 4] * (i % 2) + rnd.normal(size=dims) * 0.4], int(rnd.integers(0, 4))) for i in range(n)]
    one = rows[1][1]
    return rows + [(n + i, one, int(i % 3)) for i in range(copies)]


def negatives_of(spark, rows):
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS anchor", "'x' AS rank", "2 AS n", "3 AS a_block")
    return sorted((tuple(r) for r in mining.hard_negatives(df).collect()), key=str)


def test_negatives(spark):
    rows = made_vectors(1, 400, copies=300)
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, 1), (1050, [1.0, None, 2.0], 1), (1100, [nan] * 6, 1), (1150, [inf] * 6, 2), (1200, [0.5] * 6, None), (None, [0.5] * 6, 1), (None, [0.5] * 6, 2), (50, rows[50][1], rows[50][2]), (1250, [], 1), (1300, [1.0, 2.0], 2), (1350, [0.0] * 6, 3), (-50, [0.3] * 6, 0)]
    want = brute_negatives(rows)
    assert len(want) > 50 and negatives_of(spark, rows) == want


def test_negatives_in_small_blocks_and_digits_without_broadcast(spark, monkeypatch):
    rows = made_vectors(2, 300, copies=60)
    monkeypatch.setattr(mining, "ROWS", 16)
    monkeypatch.setattr(mining, "ANCHORS", 2)
    monkeypatch.setattr(mining, "BITS", 3)
    monkeypatch.setattr(mining, "BROADCAST", 0)
    assert negatives_of(spark, rows) == brute_negatives(rows)


def test_negatives_of_large_components(spark):
    rows = [(i, [float(2.0**20 + i), float(1 + i % 3) * 2.0**10, 3.0], i % 2) for i in range(0, 120, 5)]
    rows += [(i + 1, [0.6 * x for x in v], 1 - label) for i, v, label in rows]
    rows = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want = brute_negatives(rows)
    assert want and negatives_of(spark, rows) == want


def test_no_negatives(spark):
    assert negatives_of(spark, []) == []
    assert negatives_of(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor
    assert negatives_of(spark, [(50, [1.0], 1), (2, [0.9], 2)]) == []  # no positive
    assert negatives_of(spark, [(50, [1.0], 1), (51, [-1.0], 1), (2, [0.9], 2)]) == []  # no window below zero
    pairs = list(itertools.product([50], [51, 52]))
    assert len(pairs) == 2 and negatives_of(spark, [(50, [1.0], 1), (51, [0.0], 1), (2, [0.0], 2)]) == [(50, 51, 1, 2, 0, 0)]
