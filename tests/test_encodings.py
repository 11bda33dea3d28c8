"""Coding machines against a loop over bytes and Python's codecs, models against held-out texts."""

import random

import numpy as np
import pytest

from cuegrain.functions import machines
from cuegrain.operators import encodings

SAMPLES = {
    "utf-8": ("utf-8", "aé漢字😀 ߿ࠀ￿"), "shift_jis": ("shift_jis", "ｱｲ漢字カナabc"), "euc-jp": ("euc_jp", "漢字カナｱ丂abc"), "euc-kr": ("euc_kr", "한국어 漢字 abc"),
    "big5": ("big5", "漢字中文 abc"), "gb18030": ("gb18030", "汉字中文ԱӜabc"),
}


def loop(name, data, state=0):
    rules = machines.table(name)
    n = len(rules)
    for i, byte in enumerate(data):
        state = int(rules[state, byte])
        if state >= n - 2:
            return state, i
    return state, -1


def made(seed, n):
    rnd = random.Random(seed)
    out = [b"", b"\x80", b"\x1b", b"~{", b"a\x1b$\x1b$)C", "é".encode()[:1], b"\x1b$(D", b"~~{x", b"\x1b\x1b(J"]
    for _ in range(n):
        codec, letters = rnd.choice(list(SAMPLES.values()))
        data = "".join(rnd.choice(letters) for _ in range(rnd.randrange(40))).encode(codec, "ignore")
        if rnd.random() < 0.5:
            at = rnd.randrange(len(data) + 1)
            data = data[:at] + rnd.choice([bytes([rnd.randrange(256)]), b"\x1b$B", b"~{", b"\x1b$*H", b""]) + data[at + rnd.randrange(2) :]
        out.append(data)
    return out


@pytest.mark.parametrize("name", machines.MACHINES)
def test_vectors_equal_a_loop(name):
    for data in made(len(name), 150):
        states, stops = machines.block(name, data)
        rules = machines.table(name)
        for first in range(len(rules) - 2):
            assert (int(states[first]), int(stops[first])) == loop(name, data, first), (data, first)


def test_utf8_is_the_standards():
    rnd = random.Random(1)
    for _ in range(3000):
        data = bytes(rnd.choice([0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC1, 0xC2, 0xDF, 0xE0, 0xE1, 0xED, 0xEF, 0xF0, 0xF4, 0xF5, 0xFF]) for _ in range(rnd.randrange(6)))
        try:
            data.decode()
            valid = True
        except UnicodeDecodeError:
            valid = False
        assert (loop("utf-8", data)[0] == 0) == valid, data


@pytest.mark.parametrize("name", SAMPLES)
def test_machines_take_their_own_texts(name):
    codec, letters = SAMPLES[name]
    assert loop(name, (letters * 3).encode(codec)) == (0, -1)


@pytest.mark.parametrize("size", [1, 3, 16, 1 << 16])
def test_blocks_of_any_size(spark, size):
    texts = dict(enumerate(made(9, 60)))
    df = spark.createDataFrame([*texts.items(), (99, None)], "file long, content binary")
    got = {(r.file, r.machine): (r.state, r.stop) for r in encodings.coded(df, size=size).collect()}
    names = {0: "complete", -2: "found", -1: "error"}
    want = {}
    for file, data in texts.items():
        for name in machines.MACHINES:
            state, stop = loop(name, data)
            n = len(machines.table(name))
            want[file, name] = (names.get(state - n if state >= n - 2 else state, "partial"), None if stop < 0 else stop)
    assert got == want


def test_a_long_text_is_spread(spark):
    text = ("é" * 50_000 + "x").encode()
    df = spark.createDataFrame([(1, text), (2, text[1:])], "file long, content binary")
    parts = encodings.blocks(df, 1000)
    assert parts.rdd.getNumPartitions() > 1 and parts.count() == 201
    got = {r.file: (r.state, r.stop) for r in encodings.coded(df, ("utf-8",), 1000).collect()}
    assert got == {1: ("complete", None), 2: ("error", 0)}


def test_valid_utf8_as_spark_says(spark):
    df = spark.createDataFrame(list(enumerate(made(4, 120))), "file long, content binary")
    want = {r.file: r.ok for r in df.selectExpr("file", "is_valid_utf8(CAST(content AS string)) AS ok").collect()}
    got = {r.file: r.state == "complete" for r in encodings.coded(df, ("utf-8",), 7).collect()}
    assert got == want


def test_escapes(spark):
    rows = [(1, b"abc\x1b$Bxx\x1b$)C"), (2, b"~{ab~}"), (3, b"plain"), (4, b"\xe9\x1b$B"), (5, b"\x1b$\x1b$)A")]
    got = {r.file: (r.charset, r.stop) for r in encodings.escape_coding(spark.createDataFrame(rows, "file long, content binary"), 2).collect()}
    assert got == {1: ("iso-2022-jp", 5), 2: ("hz-gb-2312", 1), 5: ("iso-2022-cn", 5)}


def test_pair_counts(spark):
    rows = [("a", "xyx"), ("a", "xy😀"), ("b", ""), ("b", None), (None, "xy"), ("a", "x")]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    got = {(r.lang, chr(r.a), None if r.b is None else chr(r.b)): r.n for r in encodings.pair_counts(df, "lang").collect()}
    assert got == {("a", "x", "y"): 2, ("a", "y", "x"): 1, ("a", "x", None): 2, ("a", "y", "😀"): 1, ("a", "😀", None): 1, (None, "x", "y"): 1, (None, "y", None): 1}


TEXTS = {
    "fr": "où est passé l'été déjà très âgé à côté du château rêvé naïve leçon après la forêt élève être là",
    "de": "schöne grüße über die straße müssen wir größer hören für das mädchen können köln öfter zurück äpfel",
    "es": "el niño pequeño soñó mañana con una canción más allá del corazón también está aquí él dirá qué año",
}


def test_models_find_the_encoding(spark):
    rnd = random.Random(2)
    made_ = lambda lang, n: " ".join(rnd.choice(TEXTS[lang].split()) for _ in range(n))
    learn = spark.createDataFrame([(lang, made_(lang, 300)) for lang in TEXTS], "lang string, text string")
    models = encodings.EncodingModels(learn, ("cp1252", "mac_roman", "cp437"))
    assert models.ratio["fr"] > 0.5 and models.langs == ["de", "es", "fr"]
    rows, want = [], {}
    for i in range(90):
        lang, charset = rnd.choice(list(TEXTS)), rnd.choice(["cp1252", "mac_roman", "cp437", "utf-8"])
        text = made_(lang, 40)
        rows.append((i, text.encode(charset)))
        want[i] = text
    rows += [(100, b"only ascii"), (101, b""), (102, None), (103, b"\x1b$B$\"")]
    found = models.detect(spark.createDataFrame(rows, "file long, content binary"))
    got = {r.file: r.charset for r in found.collect()}
    assert got[100] == got[101] == "us-ascii" and got[103] == "iso-2022-jp" and 102 not in got
    right = [dict(rows)[i].decode(got[i], "replace") == text for i, text in want.items()]
    assert np.mean(right) >= 0.9
