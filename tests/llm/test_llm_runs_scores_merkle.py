"""Language-model scores, periodic runs and the Merkle manifest against plain versions."""

import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import awkward

import brute
from marketlens.llm import lm_scoring, merkle, periodic_runs
from marketlens.llm.queries import QUERIES
from marketlens.llm.subword_lattice import LONG, Lattice, read_vocabulary

SMALL = "/root/testdata/sf0.001"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    loop = " ".join(["a", "b", "a", "c", "a"] * 12)
    return [(i, t, s) for i, t, s in awkward() if i not in (13,)] + [
        (21, loop + " d " + loop, "a"), (21, loop + " d " + loop, "a"), (21, "other", "a"),
        (None, " ".join(r.choice("ab") for _ in range(200)), None), (None, None, "b"),
        (25, "ab " * 400, "b"), (26, "A\0b ▁c ▁ \x85x", "b")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns whose names the operators use inside."""
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    names = ("held", "block", "words", "c", "at", "n", "unit", "runs", "collapsed", "w", "g", "a", "p", "path",
             "leaf", "other", "digest", "root", "sid", "tree", "salt", "place", "runs_", "kept_", "words_",
             "c0")
    return frame.withColumns({n: F.lit(k) for k, n in enumerate(names)})


# -- scores

def test_base_scores(spark, docs, rows):
    got = ordered(lm_scoring.scores(docs, PIECES).drop("score").collect())
    told = ordered(brute.base_scores([r[:2] for r in rows]))
    for a, b in zip(got, told, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-9, rel=1e-9)


def test_scores_on_data(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    told = ordered(brute.base_scores([tuple(r) for r in docs.select("doc_id", "text").collect()]))
    got = ordered(QUERIES["op11_lm_scoring"](spark, SMALL).collect())
    for a, b in zip(got, told, strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-9, rel=1e-9)
        assert -math.inf < a[6] < 0


def test_score_is_the_mixture_of_segmentations(spark, monkeypatch):
    """Every figure of the model again by plain code, on texts of a few stretches."""
    monkeypatch.setattr(lm_scoring, "ROUNDS", 0)
    monkeypatch.setattr(lm_scoring, "SPACING", 1)  # each word is a stretch, then the end alone
    texts = ["the cat the dog", "the cat sat", "zebra 😀x the", "", "cat"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.scores(frame, PIECES, F.col("doc_id") == 2).collect()}
    pieces, p = read_vocabulary(PIECES)
    learnt = [t.split() for k, t in enumerate(texts) if k != 2]
    counts = brute.Counter(w for t in learnt for w in t)
    units = counts + brute.Counter({None: len(learnt)})

    def discount(c):
        once, twice = (sum(v == k for v in c.values()) for k in (1, 2))
        return min(max(once / (once + 2 * twice), 0.1), 0.9)

    n, m, ends = sum(counts.values()), sum(units.values()), len(learnt)
    d, e, stop = discount(counts), discount(units), (ends + 1) / (sum(counts.values()) + ends + 2)
    for k, text in enumerate(texts):
        total = 0.0
        for w in [*text.split(), None]:
            own = stop if w is None else (1 - stop) * (
                max(counts[w] - d, 0) / n + d * len(counts) / n * brute.spelt(w, pieces, p))
            total += math.log10(max(units[w] - e, 0) / m + e * len(units) / m * own)
        assert got[k]["score"] == pytest.approx(total, abs=1e-4)


def test_lattice_against_plain_sums():
    pieces, p = read_vocabulary(PIECES)
    lattice, log_p = Lattice(pieces), np.log(p)
    words = ["the", "thation", "xyz😀q", "a▁b", "Ünï", "", "a\0", "q" * 60]
    got = lattice.marginals(pa.array(words, pa.large_string()), log_p)
    assert got == pytest.approx([math.log(brute.spelt(w, pieces, p)) for w in words])
    long = ["ab" * LONG, "tion" * 60]
    alone = lattice.marginals(pa.array(long, pa.large_string()), log_p)
    assert (alone < -100).all() and np.isfinite(alone).all()
    # expected uses are the derivative of the log-probability
    one = pa.array(["thation😀"], pa.large_string())
    uses = lattice.expected(one, log_p)
    for k in np.argsort(-uses)[:6]:
        moved = log_p.copy()
        moved[k] += 1e-6
        slope = (lattice.marginals(one, moved) - lattice.marginals(one, log_p))[0] / 1e-6
        assert uses[k] == pytest.approx(slope, abs=1e-5)


def test_refitting_raises_the_likelihood(spark):
    pieces, start = read_vocabulary(PIECES)
    words = sorted({w for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()
                    for w in brute.low(r["text"]).split()})
    seen = spark.createDataFrame([(w,) for w in words], "word string")
    lattice, column = Lattice(pieces), pa.array(words, pa.large_string())
    likelihood = [lattice.marginals(column, lm_scoring.fit(seen, pieces, start, k)).sum()
                  for k in (0, 1, 2)]
    assert likelihood[0] < likelihood[1] < likelihood[2]


def test_repeated_texts_are_likelier(spark):
    """A held-out text that training holds scores above one of the same words in another order."""
    r = random.Random(2)
    stock = [f"w{k}" for k in range(300)]
    texts = [" ".join(r.choice(stock) for _ in range(80)) for _ in range(60)]
    mixed = texts[0].split()
    r.shuffle(mixed)
    frame = spark.createDataFrame(list(enumerate([*texts, texts[0], " ".join(mixed)])),
                                  "doc_id long, text string")
    got = {x["doc_id"]: x for x in lm_scoring.scores(frame, PIECES, F.col("doc_id") >= 60).collect()}
    assert got[60]["base_score"] == pytest.approx(got[61]["base_score"])
    assert got[60]["score"] > got[61]["score"] + 10


# -- periodic runs

def test_runs_against_all_lags():
    r = random.Random(1)
    texts = [["x"] * 500, ([*"ab"] * 9 + ["a"]) * 6, []]
    for k in range(400):
        n, a, b = r.randrange(160), ["a"], ["a", "b"]
        for _ in range(8):
            a, b = b, b + a
        unit = [r.choice("ab") for _ in range(r.randrange(1, 30))]
        low = [*r.choice(("ab", "aab", "a"))] * r.randrange(3, 20)
        texts.append((
            [r.choice("ab") for _ in range(n)], [r.choice("abc") for _ in range(n)], b[:n],
            (unit * 20)[:n], (([*"ab"] * r.randrange(1, 12) + ["a"]) * 12)[:n],
            ((low + [r.choice("abc")]) * r.randrange(1, 4) + low * 2)[:200])[k % 6])
    seen = 0
    for first, last, n, runs, kept in periodic_runs.search(pa.array([" ".join(t) for t in texts])):
        for k in range(last - first):
            own = texts[first + k]
            assert [tuple(x.values()) for x in runs[k].as_py()] == brute.periodic(own)
            assert kept[k].as_py() == " ".join(brute.collapsed(own)) and n[k].as_py() == len(own)
            seen += len(runs[k])
    assert seen > 1000


@pytest.mark.parametrize("text", [["x"] * 200_000, ([*"ab"] * 1000 + ["a"]) * 50,
                                  [str(k % 3000) for k in range(100_000)]])
def test_runs_of_long_texts(text):
    """Repetitive texts take no quadratic time; their longest run is the whole text."""
    (_, _, _, runs, _), = periodic_runs.search(pa.array([" ".join(text)]))
    assert max(x["length"].as_py() for x in runs[0]) == len(text)


def test_periodic_query(spark, docs, rows):
    found = ordered(periodic_runs.summary(periodic_runs.runs(periodic_runs.looped(docs))).collect())
    short = [r[:2] for r in rows if len(r[1] or "") < 100_000]
    long = [i for i, t, _ in rows if len(t or "") >= 100_000]  # random words, not looped
    assert [r for r in found if r[0] not in long] == ordered(brute.run_digests(short))
    assert [r[1] for r in found if r[0] in long] == [0] * len(long) and long


def test_periodic_query_on_data(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 20000")
    found = periodic_runs.summary(periodic_runs.runs(periodic_runs.looped(docs))).collect()
    told = brute.run_digests([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert ordered(found) == ordered(told) and sum(r["n_runs"] for r in found) > 20


def test_collapse_keeps_columns(spark, docs, rows):
    got = periodic_runs.collapse(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    (text,) = {r["text"] for r in got.where("doc_id = 25").collect()}
    assert text == "ab"
    assert got.where("doc_id = 4").first()["text"] == "one "


# -- manifest

def test_merkle_on_data(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    told = brute.merkle([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    got = QUERIES["op13_merkle"](spark, SMALL).collect()
    assert ordered(got) == ordered(told) and any(not r["verified"] for r in got)


def test_merkle_awkward(spark):
    plain = [(i, f"s{i % 3}" if i % 3 else None, "en", i, f"Text {i}") for i in range(300)] + [
        (None, "x", None, None, None), (None, "x", None, None, None), (3, "y", "", 1, ""),
        (3, "y", "", 1, "A"), *[(7, f"s{k:02}", "a", 1, "Q") for k in range(20)], *[(9, "same", "a", 1, "É")] * 40]
    frame = spark.createDataFrame(plain, "doc_id long, source string, lang string, n_chars long, text string")
    crowded = frame.withColumns({n: F.lit(1) for n in ("leaf", "path", "at", "n", "digest", "salt")})
    assert ordered(merkle.verify(crowded.repartition(7)).collect()) == ordered(brute.merkle(plain))
    wanted = spark.createDataFrame([(5,), (9,), (None,), (10**9,)], "doc_id long")
    some = merkle.verify(frame, wanted).collect()
    assert ordered(some) == ordered([r for r in brute.merkle(plain) if r[0] in (5, 9)])


@pytest.mark.parametrize("n", [0, 1, 2, 16, 17, 256, 257])
def test_merkle_sizes(spark, n):
    plain = [(i, "s", "en", 1, "T") for i in range(n)]
    frame = spark.createDataFrame(plain, "doc_id long, source string, lang string, n_chars long, text string")
    assert ordered(merkle.verify(frame).collect()) == ordered(brute.merkle(plain))


@pytest.mark.parametrize("name", ["op11_lm_scoring", "op12_periodic_runs", "op13_merkle"])
def test_empty_tables(spark, name, tmp_path):
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []
