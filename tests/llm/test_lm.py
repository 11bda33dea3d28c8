"""Language-model scores: counts and scores against brute force, and what they may not depend on."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuegrain.llm import context_mixing as cm
from cuegrain.llm.common import Scratch

SCHEMA = "doc_id bigint, text string, lang string"


def held(i):
    return zlib.crc32((str(i) if i is not None else "").encode()) % 10 == 0


def brute(rows):
    tokens = [[*(t or "").encode().lower().split(), None] for _, t, _ in rows]
    c = Counter(w for (i, _, _), ws in zip(rows, tokens) if not held(i) for w in ws)
    n, v = sum(c.values()), len(c)
    return [(i, held(i), len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for (i, _, _), ws in zip(rows, tokens)]


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    parts = {"en": ["th", "er", "on", "an"], "de": ["sch", "ei", "ung", "ü"]}
    out = []
    for i in range(400):
        lang = rnd.choice(["en", "de"])
        out.append((i, " ".join("".join(rnd.choice(parts[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(60))).title(), lang))
    return [*out, (None, "null id", None), (900, None, "en"), (901, "", None), (902, "x" * 5000 + " y", "fr"), (3, "repeated row", "en"), (3, "repeated row", "en")]


key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 3))


@pytest.mark.parametrize("limits", [{}, {"top_keys": 20, "group_rows": 7, "filter_bytes": 0}])
def test_counts(spark, rows, limits):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("word", F.lit(1)).withColumn("score", F.lit("s"))
    got = cm.lm_score(df, **limits).collect()
    for a, b in zip(sorted(got, key=key), sorted(brute(rows), key=key), strict=True):
        assert tuple(a[:5]) == b[:5]
        assert a.base_score == pytest.approx(b[5], abs=1e-6)
        assert a.score < 0 and a.bits_per_byte > 0
    some = [r for r in got if r.held_out and r.doc_id is not None]
    assert sum(r.score for r in some) > sum(r.base_score for r in some)


def test_tables(spark):
    assert cm.lm_score(spark.createDataFrame([], SCHEMA)).count() == 0
    got = cm.lm_score(spark.createDataFrame([(None, "a b")], "doc_id bigint, text string")).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in got] == [(True, 3, 0, 0)]


def test_scores_do_not_depend_on_held_out_texts_or_partitions(spark, rows):
    score = lambda df: {(r.doc_id, r.n_tokens, r.score) for r in cm.lm_score(df).collect() if not r.held_out}
    one = sorted(score(spark.createDataFrame(rows, SCHEMA)))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        other = [(i, "zzz thon " * 50 if held(i) else t, x) for i, t, x in reversed(rows)]
        two = sorted(score(spark.createDataFrame(other, SCHEMA).repartition(5)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    for a, b in zip(one, two, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-6)


def test_order_of_words_counts(spark):
    rnd = random.Random(5)
    say = lambda: "the cat of the house sat on the old mat in the sun and a dog ran to the door of the barn".split()[rnd.randrange(6) :]
    texts = [" ".join(say()) for _ in range(300)]
    mixed = [" ".join(rnd.sample(t.split(), len(t.split()))) for t in texts[:50]]
    ids = [i for i in range(2000) if held(i)][:50]
    train = [i for i in range(2000) if not held(i)][:250]
    rows = [*zip(train, texts[50:]), *zip(ids, texts[:50])]
    right = cm.lm_score(spark.createDataFrame(rows, "doc_id bigint, text string")).where("held_out").agg(F.sum("score")).first()[0]
    wrong = cm.lm_score(spark.createDataFrame([*zip(train, texts[50:]), *zip(ids, mixed)], "doc_id bigint, text string")).where("held_out").agg(F.sum("score")).first()[0]
    assert right > wrong + 50


# ---------------------------------------------------------------- brute force


def names_of(text):
    """Names of a text's model tokens, one after the other."""
    out = []
    for w in (text or "").encode().lower().split():
        parts = [w[k : k + cm.PIECE] for k in range(0, len(w), cm.PIECE)]
        out += [(b"\t" if k else b"") + p + (b"\n" if k < len(parts) - 1 else b" ") for k, p in enumerate(parts)]
    return [*out, b" "]


class Slow:
    """The scorer without Spark, trees or hashes: counts in dictionaries, one bit at a time."""

    def __init__(self, rows, fitted):
        texts = [names_of(t) for i, t, _ in rows if not held(i)]
        self.c = Counter(w for t in texts for w in t)
        pairs = Counter(p for t in texts for p in zip([b" ", *t], t))
        self.pairs = {p: n for p, n in pairs.items() if n > 1}
        self.fitted = fitted
        self.small = Counter()
        self.words, self.after = Counter(), Counter()
        for w, n in self.c.items():
            self.add(self.words, (), w, n)
            for s in self.tables(w):
                self.small[s] += n
        self.known = Counter()
        for (p, w), n in self.pairs.items():
            self.add(self.after, (p,), w, n)
            self.known[p] += n * (n > 2)

    @staticmethod
    def bits(w):
        return [(d, bit, w[d] >> bit & 1) for d in range(len(w)) for bit in range(7, -1, -1)]

    def add(self, counts, context, w, n):
        for d, bit, y in self.bits(w):
            counts[*context, w[:d], bit, w[d] >> (bit + 1), y] += n

    def tables(self, w):
        for d, bit, y in self.bits(w):
            one, two = w[d - 1] if d else 32, w[d - 2] if d > 1 else 32
            for c in ((0, one), (1, two, one), (2, min(d, 15), one)):
                yield (*c, bit, w[d] >> (bit + 1), y)

    def log(self, model, counts, context, w, sure=False):
        total = 0.0
        slots = iter(self.tables(w))
        value = lambda n: float(cm._value[cm._code(np.array([n]))[0]])
        for d, bit, y in self.bits(w):
            x, levels = [], []
            for _ in range(3):
                s = next(slots)
                n0, n1 = (value(self.small[(*s[:-1], v)]) for v in (0, 1))
                x.append(math.log((n1 + cm.DELTA) / (n0 + cm.DELTA)))
                levels.append(int(cm._seen(n0 + n1)))
            n0, n1 = (counts[*context, w[:d], bit, w[d] >> (bit + 1), v] for v in (0, 1))
            if sure and not (n0 and n1):
                continue
            x += [math.log((n1 + cm.DELTA) / (n0 + cm.DELTA)), 0.3]
            gate = (bit * cm.SEEN + int(cm._seen(n0 + n1))) * cm.SEEN + levels[1]
            p = self.p(model, x, gate, 1 << (7 - bit) | w[d] >> (bit + 1))
            total += math.log10(p if y else 1 - p)
        return total

    @staticmethod
    def p(model, x, gate, node):
        z = sum(a * b for a, b in zip(x, model.weights[gate], strict=True))
        at = (min(max(z, -11.99), 11.99) + 12) * (cm.CELLS - 1) / 24
        low = int(at)
        refined = model.cells[node, low] * (low + 1 - at) + model.cells[node, low + 1] * (at - low)
        return min(max((1 / (1 + math.exp(-min(max(z, -16), 16))) + refined) / 2, 1e-7), 1 - 1e-7)

    def score(self, text):
        total, before = 0.0, b" "
        for w in names_of(text):
            n1 = self.known[before]
            n0 = self.c[before] - n1
            x = [0, 0, 0, math.log((n1 + cm.DELTA) / (n0 + cm.DELTA)), 0.3]
            known = self.p(self.fitted.words, x, 8 * cm.SEEN**2 + int(cm._seen(n0 + n1)), 0)
            if (before, w) in self.pairs:
                total += math.log10(known) + self.log(self.fitted.pairs_model, self.after, (before,), w, True)
            else:
                total += math.log10(1 - known) + self.log(self.fitted.words, self.words, (), w)
            before = w
        return total


@pytest.mark.parametrize("group_rows", [cm.GROUP_ROWS, 5])
def test_scores_equal_brute_force(spark, rows, group_rows):
    rows = [*rows[:60], *rows[-6:-2], (905, "a" * 70 + "b" * 70 + " end", "en"), (906, "a" * 70 + "b" * 70 + " end", "en")]
    df = spark.createDataFrame(rows, SCHEMA)
    scratch = Scratch(spark)
    fitted = cm.fit(df, scratch, group_rows)
    slow = Slow(rows, fitted)
    got = cm.score_texts(df, fitted, scratch).collect()
    assert sorted(r.score for r in got) == pytest.approx(sorted(slow.score(t) for _, t, _ in rows), rel=1e-6)


def test_tables_go_before_the_next_join_is_written(spark, rows, monkeypatch):
    """What lies on disk together: of all pairs the join before, its shuffle and the next one."""
    steps, save, drop = [], Scratch.save, Scratch.drop
    monkeypatch.setattr(Scratch, "save", lambda self, df, name, **o: steps.append(name) or save(self, df, name, **o))
    monkeypatch.setattr(Scratch, "drop", lambda self, df: steps.append("-" + df._cuegrain_path.rpartition("-")[2]) or drop(self, df))
    cm.fit(spark.createDataFrame(rows[:60], SCHEMA), Scratch(spark))
    at = steps.index
    assert at("words") < at("-before") < at("scored") < at("-counted") < at("turned") < at("-scored") < at("values") < at("-turned")


def test_texts_are_looked_up_in_packed_parcels(spark, rows):
    """The keys of texts go to the values packed, never as a row each, and are written to no table."""
    scratch = Scratch(spark)
    fitted = cm.fit(spark.createDataFrame(rows[:60], SCHEMA), scratch)
    tables = scratch.n
    got = cm.score_texts(spark.createDataFrame(rows[:60], SCHEMA), fitted, scratch, top_keys=0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert scratch.n == tables and "Generate" not in plan and "Join" not in plan
    assert got.count() == 60


def test_counted_rows_of_one_kind_lie_together(spark, rows):
    """Who reads words alone skips the pages of pairs: a bucket has one run of each kind, however many parcels it got."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = cm.count_words(df).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()).collect()
    got = [(r.part, r.kind) for r in sorted(got, key=lambda r: r["at"])]
    runs = 1 + sum(a != b for a, b in zip(got, got[1:]))
    assert {k for _, k in got} == {cm.PAIR, cm.WORD, cm.LONG} and runs <= 3 * 8  # buckets


def test_only_pairs_of_rare_words_are_joined(spark, rows, monkeypatch):
    """What frequent words add to their pairs is added where these are scored; values are the same whichever way."""
    joined, join = [], cm.salted_join
    monkeypatch.setattr(cm, "salted_join", lambda left, *a, **k: joined.append(left.count()) or join(left, *a, **k))
    df = spark.createDataFrame(rows, SCHEMA)
    fit = lambda most: {r.key: (r.base, r.c, r.v) for r in cm.fit(df, Scratch(spark), near_most=most).values.collect()}
    near, some, none = fit(cm.NEAR_WORDS), fit(40), fit(0)
    assert joined[:2] == [0, 0] and 0 < joined[2] < joined[4] and 0 < joined[3] < joined[5]
    for other in (some, none):
        assert near.keys() == other.keys() and all(near[k][:2] == other[k][:2] and near[k][2] == pytest.approx(other[k][2], abs=1e-9) for k in near)
