"""Line and substring dedup, mixing and the pipeline against brute force."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cuegrain.llm import fm_dedup, line_dedup, mixing

SCHEMA = "doc_id bigint, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_windows(rows, window=fm_dedup.WINDOW):
    docs = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen, out = set(), []
    for (i, _), w in zip(docs, words):
        gone = set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone |= set(range(k, k + window))
            seen.add(key)
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=str)


def passages(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "é", "x\x1c", *[f"w{k}" for k in range(400)]])
    shared = [[word() for _ in range(rnd.choice([19, 20, 21, 45, 130]))] for _ in range(6)]
    rows = [(None, "null id " * 30), (1, None), (2, ""), (3, "a " * 300), (4, "a " * 60), (5, " ".join(f"p{k % 7}" for k in range(90)))]
    for i in range(n):
        w = [word() for _ in range(rnd.randrange(60))]
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(w) + 1)
            w[at:at] = rnd.choice(shared)
        rows.append((10 + i, rnd.choice([" ", "\n", "  "]).join(w)))
    rows += [(900 + i, rows[20][1]) for i in range(5)]
    return rows


@pytest.mark.parametrize("options", [{}, {"hot": 2}, {"filter_bytes": 0}])
def test_substrings(spark, options):
    rows = passages(3)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("row", F.lit(1)).withColumn("spans", F.lit("x"))
    got = fm_dedup.substring_dedup(df, **options).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, sha(r.kept_text)) for r in got), key=str) == brute_windows(rows)


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{k}" for k in range(40))
    got = fm_dedup.substring_dedup(spark.createDataFrame([(1, text), (1, text), (2, text)], SCHEMA)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (1, 0), (2, 40)]
    assert fm_dedup.substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_counts_every_pattern():
    rng = np.random.default_rng(5)
    s = np.r_[rng.integers(1, 5, 400), 0]
    index = fm_dedup.FmIndex(s, jump=2)
    for length in (2, 3, 5, 9):
        starts = np.arange(len(s) - length)
        at, low, high = index.repeated(s, starts, length)
        grams = [tuple(s[i : i + length]) for i in range(len(s) - length + 1)]
        assert set(at.tolist()) == {i for i in starts.tolist() if grams.count(grams[i]) > 1}
        for a, lo, hi in zip(at, low, high):
            assert sorted(index.order[lo:hi].tolist()) == [i for i, g in enumerate(grams) if g == grams[a]]


def lines(seed):
    rnd = random.Random(seed)
    blocks = [[f"line {rnd.randrange(10**6)}" for _ in range(rnd.randrange(2, 30))] for _ in range(5)]
    rows = [(1, None), (2, ""), (3, "\n\n\n"), (4, "x" * 50000), (5, "one\ntwo\nthree")]
    for i in range(150):
        out = []
        for _ in range(rnd.randrange(4)):
            out += [f"own {i} {rnd.randrange(10**6)}" for _ in range(rnd.randrange(4))] + rnd.choice(blocks)
        rows.append((10 + i, "\n".join(out)))
    return rows


def test_lines_equal_the_sql(spark):
    rows = lines(4)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    r = con.execute(line_dedup.ORACLE)
    cols = [d[0] for d in r.description]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("k", F.lit(1)).withColumn("lines", F.lit("x"))
    out = line_dedup.line_dedup(df).withColumn("kept_sha256", F.sha2("kept_text", 256)).select(*cols)
    assert sorted(tuple(x) for x in out.collect()) == sorted(r.fetchall())
    assert out.where("n_removed_lines > 0").count() > 50


def test_an_inserted_line_moves_few_boundaries(spark):
    base = [f"line {k * 7919 % 1000}" for k in range(200)]
    df = spark.createDataFrame([(1, "\n".join(base)), (2, "\n".join([*base[:50], "new", *base[50:]]))], SCHEMA)
    got = {r.doc_id: r.n_removed_lines for r in line_dedup.line_dedup(df).collect()}
    assert got[1] == 0 and got[2] > 150


def test_repeated_passages_are_found(spark):
    rnd = random.Random(12)
    new = lambda n: [f"line {rnd.random()}" for _ in range(n)]
    rows, planted = [], {}
    for k in range(300):
        passage = new(rnd.randrange(2, 6))
        for copy in range(2):
            own = new(rnd.randrange(5)) + passage + new(rnd.randrange(5))
            rows.append((2 * k + copy, "\n".join(own)))
            planted[2 * k + copy] = len(passage) * copy
    got = {r.doc_id: r.n_removed_lines for r in line_dedup.line_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] <= n for i, n in planted.items())  # nothing but later copies goes
    assert sum(got.values()) >= 0.95 * sum(planted.values())


def test_line_dedup_of_odd_tables(spark):
    assert line_dedup.line_dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "\n".join(f"line {k}" for k in range(40))
    got = line_dedup.line_dedup(spark.createDataFrame([(None, text), (1, text), (1, text), (2, text)], SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_removed_lines == 0) for r in got if r.doc_id is None) == [("None", True)]
    assert all(r.n_removed_lines > 30 for r in got if r.doc_id is not None)


MIX = "doc_id long, source string, lang string, topic string, n_tokens long"


def test_raking_meets_the_targets(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["a", "a", "a", "b", None]), rnd.choice(["en", "en", "de"]), rnd.choice(["x", "y", "y"]), rnd.randrange(1, 50)) for i in range(4000)]
    df = spark.createDataFrame(rows, MIX).withColumn("weight", F.lit(1)).withColumn("note", F.lit("kept"))
    targets = {"source": {"a": 0.3, "b": 0.3, "(none)": 0.4}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"x": 0.7, "y": 0.3}}
    for cells in (100_000, 0):
        got = mixing.mix(df, targets, keep=0.4, sweeps=12 if cells else 4, max_cells=cells).collect()
        assert len(got) == len(rows) and "note" in got[0].asDict()
        n = sum(r.n_tokens for r in got)
        assert abs(sum(r.n_tokens * r.probability for r in got) / n - 0.4) < 1e-3
        whole = sum(r.weight * r.n_tokens for r in got)
        for dim, want in targets.items():
            for value, share in want.items():
                assert abs(sum(r.weight * r.n_tokens for r in got if (r[dim] or "(none)") == value) / whole - share) < 0.01
        assert abs(sum(r.n_tokens for r in got if r.kept) / n - 0.4) < 0.05


def test_exact_mixing_meets_the_targets_in_the_sample(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice("aaab"), rnd.choices(["en", "de", "fr"], [80, 15, 5])[0], rnd.choice(["x", "y", "y"]), rnd.randrange(1, 50)) for i in range(6000)]
    df = spark.createDataFrame(rows, MIX)
    tokens = sum(r[4] for r in rows)
    for cells in (100_000, 0):
        got = mixing.mix(df, keep=0.9, exact=True, sweeps=12 if cells else 5, max_cells=cells).collect()
        kept = sum(r.n_tokens * r.probability for r in got)
        room = []
        for d, dim in enumerate(mixing.DIMS, 1):
            share = {v: sum(r[4] for r in rows if r[d] == v) / tokens for v in {r[d] for r in rows}}
            for v, x in share.items():
                want = x**0.5 / sum(y**0.5 for y in share.values())
                room.append(x / want)
                assert abs(sum(r.n_tokens * r.probability for r in got if r[dim] == v) / kept - want) < 0.01 * want
                assert abs(sum(r.n_tokens for r in got if r.kept and r[dim] == v) / sum(r.n_tokens for r in got if r.kept) - want) < 0.04
        assert 0.9 * min(room) < kept / tokens < 1.01 * min(room) < 0.9


def test_exact_mixing_keeps_rare_values_whole(spark):
    rows = [(i, "a", "en" if i % 5 else "de", "x", 20) for i in range(3000)] + [(5000, "a", "en", "rare", 2)]
    for cells in (100_000, 0):
        with pytest.warns(UserWarning, match="topic rare: target 0.0057"):
            got = mixing.mix(spark.createDataFrame(rows, MIX), exact=True, keep=0.9, sweeps=4, max_cells=cells).collect()
        kept = sum(r.n_tokens * r.probability for r in got)
        assert [r.probability for r in got if r.topic == "rare"] == [1] and kept > 0.55 * 60000
        assert abs(sum(r.n_tokens * r.probability for r in got if r.lang == "de") / kept - 1 / 3) < 0.003


def test_exact_mixing_names_targets_out_of_reach(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else "b", "en" if i % 2 else "de", "x", 10) for i in range(100)], MIX)
    with pytest.warns(UserWarning, match="source a: target 0.7"):
        mixing.mix(df, {"source": {"a": 0.7, "b": 0.3}, "lang": {"en": 0.3, "de": 0.7}}, exact=True)


def test_pipeline_mixing_has_the_target_shares(spark):
    import corpus_pipeline as cp

    docs = spark.createDataFrame([(i, "w " * 40, "de" if i % 10 == 0 else "en", "s") for i in range(4000)], "doc_id bigint, text string, lang string, source string")
    n = {r.lang: r["count"] for r in cp.mixing_sources(spark, docs, "").groupBy("lang").count().collect()}
    assert abs(n["de"] / (n["de"] + n["en"]) - 0.1**0.5 / (0.1**0.5 + 0.9**0.5)) < 0.03


def test_mixing_of_odd_tables(spark):
    assert mixing.mix(spark.createDataFrame([], MIX)).count() == 0
    got = mixing.mix(spark.createDataFrame([(None, None, None, None, 0), (1, "a", "en", "x", 0), (1, "a", "en", "x", 0)], MIX)).collect()
    assert len(got) == 3 and all(0 <= r.probability <= 1 for r in got)


def test_both_ways_of_raking_agree_on_absent_targets(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice("aab"), rnd.choice(["en", "de"]), "x", rnd.randrange(1, 50)) for i in range(500)]
    df = spark.createDataFrame(rows, MIX).withColumn("_source", F.lit("mine"))
    targets = {"source": {"a": 0.1, "b": 0.1, "absent": 0.8}, "lang": {"en": 0.9, "de": 0.1}}
    one, two = (sorted(mixing.mix(df, targets, keep=0.8, sweeps=4, max_cells=n).collect()) for n in (100, 0))
    for a, b in zip(one, two, strict=True):
        assert a._source == "mine"
        assert abs(a.weight - b.weight) < 1e-6 and abs(a.probability - b.probability) < 1e-6
    with pytest.raises(ValueError, match="source"):
        mixing.mix(df, {"source": {"absent": 1.0}})


def test_pipeline_stages_on_odd_tables(spark):
    import corpus_pipeline as cp

    schema = "doc_id bigint, text string, lang string, source string, weight bigint, topic string, score string, n_chars bigint"
    long = " ".join(f"word{i}" for i in range(300))
    row = lambda i, t: (i, t, None, "s", 9, "mine", "x", 1)
    rows = [row(3, long), row(5, long), row(5, "another text of this id"), row(5, "another text of this id"), row(None, None), row(None, ""), row(7, "long " * 20000)]
    df = spark.createDataFrame(rows, schema)
    ids = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    stay = ids(cp.exact_duplicates(spark, df, ""))
    assert [x for x in stay if x[0] is not None] == sorted([(3, long), (5, rows[2][1]), (7, rows[6][1])], key=str) and len(stay) == 4
    near = ids(cp.near_duplicates(spark, df, ""))
    assert [x for x in near if x[0] is not None] == sorted([(3, long), (5, rows[2][1]), (7, rows[6][1])], key=str)
    mixed = cp.mixing_sources(spark, df, "")
    assert mixed.columns == df.columns and all((r.weight, r.topic, r.score) == (9, "mine", "x") for r in mixed.collect())
    for _, stage in cp.STAGES[1:]:
        assert stage(spark, df.limit(0), "").count() == 0


def test_quality_stage_keeps_clashing_columns(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({"score": F.lit("mine"), "predicted": F.lit("no")})
    got = cp.quality_classifier(spark, docs, "/root/testdata/sf0.001")
    assert got.columns == docs.columns and {(r.score, r.predicted) for r in got.collect()} == {("mine", "no")}


def test_pipeline(spark):
    import corpus_pipeline as cp
    from cuegrain.llm import exact_dedup, simhash

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = docs
    for name, stage in cp.STAGES[:-1]:
        before = kept
        kept = stage(spark, kept, sf)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
        assert kept.exceptAll(before).count() == 0
        ids = {r.doc_id for r in before.collect()} - {r.doc_id for r in kept.collect()}
        if name == "exact dedup":
            assert ids == {r.doc_id for r in exact_dedup.exact_dedup(before).where("NOT kept").collect()}
        if name == "SimHash near-dedup":
            groups = simhash.simhash_near_dedup(before).collect()
            assert ids == {r.doc_id for r in groups if r.doc_id != r.component_id}
    out = cp.STAGES[-1][1](spark, kept, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in kept.collect())
    assert all(r.round_trip and len(r.ids) == r.n_tokens for r in out)
    assert len(cp.run(spark, sf).collect()) == len(out)
