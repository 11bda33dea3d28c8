"""Quality rules, the byte network and the transducers on small inputs."""

import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

from cuegrain.llm import quality_cnn, quality_rules, sentencepiece_fst
from cuegrain.llm.quality_rules import repeated_words

SCHEMA = "doc_id bigint, text string"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "é" * 200000), (5, "a b c"), (5, "a b c"), (None, "x #|<\n\nx #|<\n y")]


def slow_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    win = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    rep = {j for i in range(len(words) - 7) if win[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, dup = set(), 0
    for x in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in lines
            lines.add(x)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(rep), n < 20 or 100 * len(rep) > 30 * n


def test_rules(spark):
    rnd = random.Random(4)
    rows = list(ODD)
    for i in range(80):
        words = [rnd.choice(["the", "é", "#x", "|", "w\x1c", "tä"]) + str(rnd.randrange(rnd.choice([1, 3, 500]))) for _ in range(rnd.choice([7, 8, 9, 25, 200]))]
        rows.append((100 + i, "".join(w + rnd.choice([" ", "\n", "  ", "\t"]) for w in words)))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_words", F.lit("x"))
    got = quality_rules.quality_rules(df)
    want = Counter((i, *slow_rules(t)) for i, t in rows)
    assert Counter(tuple(r[:7]) for r in got.collect()) == want
    assert got.where("base_failed AND kept").count() == 0


def test_bands_reject_repetition_and_noise(spark):
    rnd = random.Random(5)
    prose = " ".join("".join(rnd.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rnd.randrange(1, 5))) for _ in range(900))
    noise = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(40)) for _ in range(60))
    repeat = " ".join(f"{a} {b}" for a in range(40) for b in ["alpha beta gamma delta epsilon zeta eta theta iota kappa"])
    half = prose[:4096] + "ab" * 4096
    df = spark.createDataFrame([(1, prose), (2, noise), (3, repeat), (4, half)], SCHEMA)
    assert {r.doc_id: r.kept for r in quality_rules.quality_rules(df).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_bands_come_from_clean_documents(spark):
    rnd = random.Random(9)
    word = lambda parts: "".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 5)))
    some = ["th", "er", "on", "an", "re", "he", "in", "ed"]
    clean = [" ".join(word([*some, "ou", "st", "ly", "ma", "pi", "go", "uc", "ek"]) for _ in range(500)) for _ in range(260)]
    junk = [" ".join(word(some) for _ in range(500)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(clean + junk)), SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 260)) for i in range(290)] + [(270, 1), (None, 1)], "doc_id bigint, quality int")
    kept = lambda **bands: Counter(r.doc_id < 260 for r in quality_rules.quality_rules(df, **bands).collect() if r.kept)
    assert kept() == {True: 260, False: 40}
    bands, chunk_bands = quality_rules.fit_bands(df, labels)
    got = kept(bands=bands, chunk_bands=chunk_bands)
    assert got[True] > 250 and got[False] == 0
    assert quality_rules.fit_bands(df, labels.limit(0))[0] == quality_rules.BANDS


def test_short_last_chunks_count():
    rnd = random.Random(10)
    text = bytes(rnd.choice(b"abcdefgh ") for _ in range(quality_rules.CHUNK)) + b"a" * 800
    assert quality_rules.judge(text, zstandard.ZstdCompressor(level=3))[8:] == (2, 1)


def test_repeated_words_of_other_windows():
    rnd = random.Random(6)
    for window in (1, 2, 3, 5, 8, 11):
        words = [rnd.choice([b"a", b"b", b"c"]) for _ in range(60)]
        win = Counter(tuple(words[i : i + window]) for i in range(61 - window))
        assert repeated_words(words, window) == len({j for i in range(61 - window) if win[tuple(words[i : i + window])] > 1 for j in range(i, i + window)})


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        text = bytes(random.Random(n).randrange(1, 256) for _ in range(n))
        c = quality_cnn.cut(text)
        assert b"".join([c[0].tobytes(), *(x[quality_cnn.CHUNK - quality_cnn.HOP :].tobytes() for x in c[1:])]).rstrip(b"\0") == text


def test_network_learns(spark):
    rnd = random.Random(8)
    rows, labels = list(ODD), []
    for i in range(1000, 1900):
        good = i % 2
        rows.append((i, " ".join(rnd.choice(["there", "onto", "rest"] if good else ["XX!!", "Q##", "%%"]) + "abcdef"[rnd.randrange(6)] for _ in range(rnd.randrange(30, 300)))))
        labels.append((i, good, 0))
    labels += [(1, None, None), (None, 1, 0), (1000, 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("note", F.lit(1))
    got = quality_cnn.classify(df, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert np.mean([r.predicted == r.doc_id % 2 for r in got if (r.doc_id or 0) >= 1000]) > 0.98


def test_network_without_labels(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.score for r in quality_cnn.classify(df, none).collect()} == {0.5}
    assert quality_cnn.classify(df.limit(0), none).count() == 0


@pytest.fixture(scope="module")
def both():
    path = sentencepiece_fst.default_model()
    with open(path, "rb") as f:
        return sentencepiece_fst.Transducer(f.read()), sentencepiece.SentencePieceProcessor(model_file=path)


def test_paths_equal_the_library(both):
    ours, theirs = both
    rnd = random.Random(2)
    parts = list("abcdethn   \n\t\r\x0b▁éßñ日本語😀\x00\x1c'.,{}()<>=;:/0123456789") + ["the", "ing", "tion", "  ", "    ", "\r\n", "return ", "ÿ", "<s>", "<unk>"]
    for _ in range(6000):
        s = "".join(rnd.choice(parts) for _ in range(rnd.randrange(25)))
        assert ours.encode(s).tolist() == theirs.encode(s), repr(s)


def message(*fields):
    """A protocol-buffer message of (number, value)."""
    out = b""
    for n, v in fields:
        if isinstance(v, float):
            out += bytes([n << 3 | 5]) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += varint(n << 3) + varint(v)
        else:
            out += varint(n << 3 | 2) + varint(len(v)) + v
    return out


def varint(n):
    return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)


def unigram(fallback, rules=b"", squeeze=1, prefix=1):
    """A model written by hand: scores are no multiples of each other, so few paths weigh the same."""
    rnd = random.Random(11)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{k:02X}>", 0.0, 6) for k in range(256) if fallback)]
    words = sorted({"".join(rnd.choice("▁abcdeé") for _ in range(rnd.randrange(1, 5))) for _ in range(150)} - {"d"})
    pieces += [(w, -rnd.uniform(1, 9), 1) for w in words] + [("ab▁c", 0.0, 4)]
    body = b"".join(message((1, message((1, w.encode()), (2, x), (3, k)))) for w, x, k in pieces)
    return body + message((2, message((3, 1), (35, int(fallback)))), (3, message((2, rules), (3, prefix), (4, squeeze), (5, 1))))


@pytest.fixture(scope="module")
def rules():
    """The character map that the library has built in."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto()
    return dict(sentencepiece_fst._fields(dict(sentencepiece_fst._fields(spec))[3]))[2]


@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("options", [{}, {"squeeze": 0}, {"prefix": 0}, {"map": True}])
def test_unigram_paths_equal_the_library(rules, fallback, options):
    options = dict(options)
    model = unigram(fallback, rules if options.pop("map", False) else b"", **options)
    ours, theirs = sentencepiece_fst.Transducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    rnd = random.Random(3)
    for _ in range(1500):
        s = "".join(rnd.choice("aabbccdeéÉABx  日ﬁ①\t\u3000Ａ▁") for _ in range(rnd.randrange(20)))
        assert ours.encode(s).tolist() == theirs.encode(s), repr(s)
        assert ours.decode(ours.encode(s)).decode("utf-8", "replace") == theirs.decode(theirs.encode(s)), repr(s)


def test_unigram_paths_weigh_least():
    ours = sentencepiece_fst.Transducer(unigram(True))
    rnd = random.Random(5)
    for _ in range(300):
        s = "".join(rnd.choice("▁abcdeéx") for _ in range(rnd.randrange(1, 9)))
        ways = [[]]
        least = math.inf
        for cuts in range(1 << (len(s) - 1)):
            at = [0, *(k + 1 for k in range(len(s) - 1) if cuts >> k & 1), len(s)]
            ways = [s[a:b] for a, b in zip(at, at[1:])]
            if all(p in ours.score or len(p) == 1 for p in ways):
                least = min(least, ours.weight(ways))
        assert ours.weight(ours.shortest(s)) == pytest.approx(least)


def test_decoded_ids_equal_the_library(both):
    ours, theirs = both
    rnd = random.Random(6)
    ascii_ = [i for i in range(theirs.get_piece_size()) if not theirs.is_byte(i)]
    for _ in range(2000):
        ids = [rnd.choice(ascii_) for _ in range(rnd.randrange(1, 8))]
        assert ours.decode(np.array(ids)).decode() == theirs.decode(ids), ids


def test_round_trip(spark):
    rows = [*ODD, (6, "a\x00b \r\n  x ▁"), (7, "  lead and trail  "), (8, "日本😀" * 50)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ids", F.lit("x"))
    got = sentencepiece_fst.digest(df).collect()
    assert len(got) == len(rows)
    assert sentencepiece_fst.digest(df.limit(0)).count() == 0
    assert [r.doc_id for r in got if not r.round_trip] == [6]  # the mark itself reads back as a space
    assert {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
