"""Every operator against its plain version, on data and on awkward rows."""

import functools
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from marketlens.llm import (
    decontaminate, exact_dedup, jaccard_join, line_dedup, mixing, pii, quality, suffix_dedup,
    token_counts, token_files,
)
from marketlens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
WORD_BPE, BYTE_BPE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
PASSAGE = ("the quick brown fox jumps over the lazy dog near the river bank while seven small "
           "birds sing old songs about winter and the sea")


def awkward():
    """doc_id, text, source: nulls, blanks, long and repeated texts, ties."""
    r = random.Random(5)
    prose = " ".join(r.choice(("alpha", "béta", "gamma", "delta", "42", "x")) for _ in range(300))
    long = " ".join(f"w{r.randrange(5000)}" for _ in range(40000))
    return [
        (0, None, "a"), (1, "", None), (2, " \t\n", "a"), (3, "one", "b"), (4, "one ", "b"),
        (5, PASSAGE, "b"), (6, "Intro. " + PASSAGE.upper() + " end", None), (7, prose, "c"),
        (8, prose.replace("gamma", "gamma", 1) + " tail", "c"), (9, long, "a"),
        (10, long + " more", "zz"), (11, "line one\nline two\nline three\nline four\n" * 9, "c"),
        (12, "head\n" + "line one\nline two\nline three\nline four\n" * 9, "c"),
        (13, "ab" * 40000, "a"), (14, "ab" * 300, "b"), (15, "a@b.co +1 (743) 555-3824 1.2.3.4", "b"),
        (16, "a@b.co.x 4111 1111 1111 1111 999.1.1.1 é 10.0.0.255 +12", None),
        (17, "<|endoftext|> it's 5<|startoftext|>", "b"), (18, prose, "c"), (19, "😀".encode(
            "utf-16", "surrogatepass").decode("utf-16") * 70, "é"), (20, "Á ﬁ İ Σ K", "é"),
    ]


@pytest.fixture(scope="module")
def rows():
    return awkward()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


@pytest.fixture(scope="module")
def clashing(docs):
    """The same rows with columns whose names operators use inside."""
    names = ("key", "row", "doc", "tie", "rid", "n", "label", "hits", "items", "path", "size",
             "_id", "c0", "content", "kept", "start", "stop", "chunk", "norm", "rank", "n_words")
    return docs.withColumns({n: F.lit(k) for k, n in enumerate(names)})


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def found(df, *columns):
    got = {}
    for r in df.collect():
        assert r["doc_id"] not in got
        got[r["doc_id"]] = tuple(r[c] for c in columns)
    return got


def empty(df):
    return df.where("false")


ITEMS = [(7, PASSAGE), (8, "one"), (9, None), (None, "w1 w2 w3"), (10, "?!"), (11, PASSAGE)]


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.fixture(scope="module")
def ratings(spark):
    return spark.createDataFrame([(i, i % 3) for i in range(15)] + [(3, None), (None, 1), (4, 0)],
                                 "doc_id long, grade long")


def test_mixing(docs, clashing, small):
    for frame, data in ((docs, awkward()), (small, [
            (r["doc_id"], r["text"], r["source"]) for r in small.collect()])):
        size, share = brute.targets(data)
        got = mixing.taken(frame).collect()
        assert len(got) == len(data)
        own = dict(zip((i for i, _, _ in data), brute.sizes(data), strict=True))
        words = {}
        for r in got:
            assert r["size"] == own[r["doc_id"]] and r["source_size"] == size[r["source"]]
            assert r["target"] == pytest.approx(float(share[r["source"]]), rel=1e-9)
            assert 0 <= r["taken"] <= 3 * r["size"]
            words[r["source"]] = words.get(r["source"], 0) + r["taken"]
        for s, n in words.items():
            assert abs(n - float(share[s])) <= 0.5 + 1e-6
        again = mixing.taken(frame.repartition(3)).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)
    mixed = mixing.mix(clashing)
    assert mixed.columns == clashing.columns
    assert mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert mixing.taken(empty(docs)).count() == 0 and mixing.mix(empty(docs)).count() == 0
    wordless = docs.where("doc_id < 3")
    assert {r["taken"] for r in mixing.taken(wordless).collect()} == {0}


def test_mixing_shards_draw_every_slot_once(docs):
    sizes = mixing._sizes(docs)
    parts = sizes.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    targets = mixing._targets(parts, mixing.WEIGHTS)
    drawn = mixing.draws(targets)
    assert drawn.agg(F.sum("drawn")).first()[0] == targets.agg(F.sum("slots")).first()[0]
    assert drawn.groupBy("shard").agg(F.sum("drawn").alias("n")).where(
        f"n > {mixing.SHARD}").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 1000])
def test_permutation(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k")).alias("p"))
    assert sorted(r["p"] for r in got.collect()) == list(range(n))


@pytest.mark.parametrize("giant", [20_000, 1])
def test_suffix_dedup(monkeypatch, docs, clashing, small, giant):
    monkeypatch.setattr(suffix_dedup, "GIANT", giant)
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    for frame in (docs, small):
        assert found(suffix_dedup.removals(frame), *columns) == brute.repeats(texts(frame))
    assert found(suffix_dedup.removals(clashing), *columns) == brute.repeats(texts(docs))
    assert suffix_dedup.removals(empty(docs)).count() == 0


def test_suffix_removals_hold_the_texts_in_one_worker_a_task(spark):
    # a second Python pass over the texts keeps a second worker with its memory a core
    frame = spark.createDataFrame([(1, "a" * 60)], "doc_id long, text string")
    plan = suffix_dedup.removals(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Join")[0].count("MapInArrow") == 1


def test_suffix_dedup_shared_and_null_ids(spark):
    a, b = PASSAGE, PASSAGE + " and more of it"
    frame = spark.createDataFrame([(1, a), (1, b), (None, b), (0, "x")], "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["n_bytes"], r["n_removed"])
                 for r in suffix_dedup.removals(frame).collect())
    # rows of one id do not remove from one another; a null id comes last and loses all
    assert got == [(False, 1, 0), (False, len(a), 0), (False, len(b), 0), (True, len(b), len(b))]


def test_suffix_dedup_long_text_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 100)
    r = random.Random(2)
    base = "".join(r.choice("abcdef ") for _ in range(900))
    data = [(1, base), (2, base[100:700] + "!" + base[300:]), (3, base[:49])]
    frame = spark.createDataFrame(data, "doc_id long, text string")
    columns = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert found(suffix_dedup.removals(frame), *columns) == brute.repeats(data)


def test_pii(spark, docs, clashing, small):
    r = random.Random(3)
    bits = [*"a1029 .@+-()_%é😀 5", "1.2.3.4", "@b.c", "4111111111111111", "+1 (743) 555-3824"]
    fuzz = spark.createDataFrame(
        [(i, "".join(r.choice(bits) for _ in range(r.randrange(60)))) for i in range(400)]
        + [(900, "1" * 30000), (901, "a." * 20000 + "@x.y"), (902, "+1" * 9000)],
        "doc_id long, text string")
    names = [f"n_{k}" for k in pii.KINDS]
    for frame in (docs, clashing, small, fuzz):
        got = {r["doc_id"]: r for r in pii.find(frame).collect()}
        assert len(got) == frame.count()
        for i, t in texts(frame):
            spans = brute.base_spans(t)
            assert [got[i][n] for n in names] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
            assert got[i]["base_sha256"] == brute.sha(brute.listed(spans))
            listed = got[i]["spans"].split(",") if got[i]["spans"] else []
            assert set(brute.listed(spans).split(",") if spans else []) <= set(listed)
            assert len(listed) == len(spans) + got[i]["n_added"]
            at = sorted(tuple(map(int, x.split(":")[1:])) for x in listed)
            assert all(a < b <= len(t) for a, b in at)
    assert pii.find(empty(docs)).count() == 0


def test_pii_adds_what_it_has_learnt(spark):
    r = random.Random(1)
    real = [(i, f"please call +1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)} now") for i in range(200)]
    fake = [(1000 + i, f"order {r.randrange(10**6, 10**7)}-{r.randrange(10**8, 10**9)}{r.randrange(10**3)} is late")
            for i in range(200)]
    written = [(2000 + i, f"write to me.{i}(at)mail.example.com please") for i in range(5)]
    mails = [(3000 + i, f"write to me.{i}@mail.example.com please") for i in range(200)]
    frame = spark.createDataFrame(real + fake + written + mails, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(frame).collect()}
    assert all(got[i]["n_phone"] == 1 for i, _ in real) and all(got[i]["n_email"] == 1 for i, _ in mails)
    assert not any(got[i]["n_added"] for i, _ in real)


def test_pii_learns_from_all_decided_proposals(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(pii, "stored", lambda df, name: kept.append(df.cache()) or kept[-1])
    n = 21_000
    told = spark.range(n).select(
        F.col("id").alias("rid"), F.lit(0).cast("long").alias("start"), F.lit("phone").alias("kind"),
        (F.col("id") % 3 == 0).cast("double").alias("label"),
        ((F.col("id") % 3 == 0).cast("double") + F.col("id") % 2).alias("f_a"))
    model, cuts = pii.train(told, ["f_a"])
    assert kept[0].agg(F.sum("alike")).first()[0] == n and kept[0].count() < 20
    assert model.getNumTrees == pii.TREES and set(cuts) <= {"phone"}


def test_exact_dedup(docs, clashing, small):
    columns = ("keep_id", "group_size", "kept", "text_sha256")
    for frame in (docs, clashing, small):
        assert found(exact_dedup.classes(frame), *columns) == brute.exact_classes(texts(frame))
    kept = exact_dedup.deduplicate(clashing)
    assert kept.columns == clashing.columns
    assert {r["doc_id"] for r in kept.collect()} == {
        i for i, v in brute.exact_classes(texts(docs)).items() if v[2]}
    assert exact_dedup.classes(empty(docs)).count() == 0


def test_exact_dedup_null_and_repeated_ids(spark):
    frame = spark.createDataFrame([(None, "a b"), (5, "ab"), (5, "ab"), (None, "z")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"])
                 for r in exact_dedup.classes(frame).collect())
    # the longer original stays although its id is null
    assert got == [("5", "None", 3, False), ("5", "None", 3, False), ("None", "None", 1, True),
                   ("None", "None", 3, True)]


def test_exact_dedup_decides_by_id_and_text(spark):
    frame = spark.createDataFrame(
        [(1, "a b c", "p"), (2, "abc", "q"), (2, "zzz", "r"), (3, "x y", "s"), (3, "xy ", "t")],
        "doc_id long, text string, tie string")
    got = {r["tie"] for r in exact_dedup.deduplicate(frame).collect()}
    # the copy under id 2 goes, the other text under id 2 stays; of two rows of id 3 one stays
    assert got in ({"p", "r", "s"}, {"p", "r", "t"})
    flags = [(r["doc_id"], r["kept"]) for r in exact_dedup.classes(frame).collect()]
    assert sorted(flags) == [(1, True), (2, False), (2, True), (3, False), (3, True)]


def test_exact_dedup_slices_large_groups(spark):
    data = ([(i, "same text" + " " * (i % 3)) for i in range(3000)] + [(i, "") for i in range(3000, 5000)]
            + [(i, f"own {i}") for i in range(5000, 6000)])
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    columns = ("keep_id", "group_size", "kept", "text_sha256")
    assert found(exact_dedup.classes(frame), *columns) == brute.exact_classes(data)
    assert exact_dedup.deduplicate(frame).count() == 1002


def test_exact_dedup_shuffles_texts_once(small, monkeypatch):
    plans = []
    keep = exact_dedup.stored

    def noted(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, name)

    monkeypatch.setattr(exact_dedup, "stored", noted)
    exact_dedup.classes(small)
    plan = dict(plans)["exact-runs"]
    # the broadcast list of slices is counted by hash; the texts meet by range only
    assert plan.count("Exchange rangepartitioning") == 1
    assert "Exchange hashpartitioning(prefix" not in plan and "hashpartitioning(norm" not in plan


def test_quality_learns_grades(spark):
    r = random.Random(4)
    plain = [f"w{k}" for k in range(50)]

    def text(kind):
        own = [r.choice(plain) for _ in range(r.randrange(20, 120))]
        if kind == 0:
            own[3:5] = ["idiot", "moron"]
        if kind == 1:
            own = [w.upper() + "!!###" for w in own]
        return " ".join(own)

    data = [(i, text(i % 3), i % 3) for i in range(1200)]
    frame = spark.createDataFrame(data, "doc_id long, text string, g long")
    told = frame.where("doc_id < 900").select("doc_id", F.col("g").alias("grade"))
    got = quality.scores(frame, told).join(frame, "doc_id").where("doc_id >= 900").collect()
    for grade in range(3):
        kept = [x["kept"] for x in got if x["g"] == grade]
        assert (sum(kept) / len(kept) > 0.97) if grade == 2 else sum(kept) / len(kept) < 0.03
    means = [sum(x["expected_grade"] for x in got if x["g"] == g) for g in range(3)]
    assert means[0] < means[1] < means[2]


def test_quality_uses_ratings_that_have_a_text(spark, monkeypatch):
    """Ratings of documents that are not there take no place in the sample."""
    monkeypatch.setattr(quality, "SAMPLE", 300)
    words = {0: "bad awful poor", 1: "good fine great"}
    data = [(i, " ".join([words[i % 2]] * 5 + [f"w{i}"])) for i in range(400)]
    ratings = spark.range(20000).selectExpr("id AS doc_id", "id % 2 AS grade")
    frame = spark.createDataFrame(data, "doc_id long, text string")
    tail = {r["doc_id"]: r["tail_probability"] for r in quality.scores(frame, ratings).collect()}
    # of 20000 ratings, 300 by hash alone would leave about 6 with a text
    assert min(tail[i] for i in range(1, 400, 2)) > 0.9 > 0.1 > max(tail[i] for i in range(0, 400, 2))


def test_quality_awkward(docs, clashing, ratings):
    got = quality.scores(clashing, ratings).collect()
    assert len(got) == docs.count() and all(0 <= r["tail_probability"] <= 1 for r in got)
    chosen = quality.select(clashing, ratings)
    assert chosen.columns == clashing.columns
    assert {r["doc_id"] for r in chosen.collect()} == {r["doc_id"] for r in got if r["kept"]}
    assert quality.scores(empty(docs), ratings).count() == 0
    one = quality.scores(docs, ratings.where("grade = 1")).collect()
    assert {r["expected_grade"] for r in one} == {1.0} and all(r["kept"] for r in one)
    none = quality.scores(docs, empty(ratings)).collect()
    assert {r["expected_grade"] for r in none} == {None} and all(r["kept"] for r in none)


def test_quality_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = quality.graded(spark.read.parquet(f"{folder}/labels.parquet"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    got = quality.scores(docs, labels.where(~held)).join(labels.where(held), "doc_id").collect()
    good = [r["kept"] for r in got if r["grade"] == 2]
    poor = [r["kept"] for r in got if r["grade"] < 2]
    # three hundred ratings only: the grades part, but not yet sharply
    assert sum(good) / len(good) > sum(poor) / len(poor) + 0.3


def test_line_dedup(docs, clashing, small):
    columns = ("n_lines", "n_chunks", "n_removed", "removed_lines")
    for frame in (docs, clashing, small):
        told = brute.line_removals(texts(frame))
        assert found(line_dedup.removals(frame), *columns) == {i: v[:4] for i, v in told.items()}
        assert {r["doc_id"]: r["kept_bytes"] for r in line_dedup.removals(frame).collect()} == {
            i: len(v[4].encode()) for i, v in told.items()}
        clean = line_dedup.deduplicate(frame)
        assert clean.columns == frame.columns
        assert {r["doc_id"]: r["text"] or "" for r in clean.collect()} == {i: v[4] for i, v in told.items()}
    assert line_dedup.removals(empty(docs)).count() == 0


def test_line_dedup_passages(spark):
    """Planted passages of 2 to 8 lines go whole, once; lines shared alone or in short runs stay."""
    r = random.Random(3)

    def made(n, words=30):
        return [" ".join(f"w{r.randrange(10**6)}" for _ in range(words)) for _ in range(n)]

    planted = [made(2 + p % 7) for p in range(40)]
    line, brief = made(1, 80), made(3, 5)
    data, want = [], {}
    for i in range(120):
        first, own, last = made(1 + i % 3), planted[i % 40], made(2)
        data.append((i, "\n".join(first + own + last + line + made(1) + brief + made(1))))
        want[i] = [x for x in data[i][1].split("\n") if i < 40 or x not in own]
    frame = spark.createDataFrame(data + [(None, data[0][1]), (7, data[7][1])], "doc_id long, text string")
    got = [(x["doc_id"], x["text"]) for x in line_dedup.deduplicate(frame, passages=True).collect()]
    told = {x["doc_id"]: x for x in line_dedup.removals(frame, passages=True).collect()}
    chunked = {x["doc_id"]: x for x in line_dedup.removals(frame).collect()}
    assert len(got) == 122
    for i, text in got:
        assert told[i]["kept_bytes"] == len((text or "").encode())
        if i is None:
            assert text == "" and told[i]["removed_lines"] == told[i]["n_lines"]
        elif told[i]["n_removed"] == 0:
            assert text.split("\n") == want[i]
        assert not i or i < 40 or not set(planted[i % 40]) & set(text.split("\n"))
        assert all(told[i][c] == chunked[i][c] for c in ("n_lines", "n_chunks", "n_removed"))
    assert line_dedup.removals(empty(frame), passages=True).count() == 0


def test_line_dedup_as_registered(spark, docs, small):
    """Chunks and passages together, line by line, against all pairs of texts."""
    r = random.Random(11)
    stock = [" ".join(f"w{r.randrange(50)}" for _ in range(r.choice((0, 1, 4, 9, 20, 55)))) for _ in range(25)]
    data = []
    for i in range(60):
        mine = [r.choice(stock) for _ in range(r.randrange(1, 9))]
        if data and r.random() < 0.6:
            other = r.choice(data)[1].split("\n")
            at = r.randrange(len(other))
            mine[r.randrange(len(mine) + 1):0] = other[at:at + r.randrange(1, 7)]
        data.append((i, "\n".join(mine)))
    made = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    few = small.where("doc_id < 40 or doc_id % 9 = 0")
    for frame in (made, docs.where("doc_id not in (9, 10, 13)"), few):
        rows = [(x["doc_id"], x["text"]) for x in frame.select("doc_id", "text").collect()]
        gone = brute.passage_lines(rows) | brute.chunk_lines(rows)
        want = {i: "\n".join(x for k, x in enumerate((t or "").split("\n")) if (i, k) not in gone)
                for i, t in rows}
        clean = line_dedup.deduplicate(frame, passages=True)
        assert {x["doc_id"]: x["text"] or "" for x in clean.collect()} == want
        told = {x["doc_id"]: x for x in line_dedup.removals(frame, passages=True).collect()}
        assert {i: x["removed_lines"] for i, x in told.items()} == {
            i: sum(d == i for d, _ in gone) for i in want}
        assert {i: x["kept_bytes"] for i, x in told.items()} == {i: len(t.encode()) for i, t in want.items()}


def test_line_dedup_keeps_what_no_text_holds_in_one_piece(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(1, f"{a}\n{b}"), (2, f"{b}\n{c}"), (3, f"{a}\n{b}\n{c}"), (4, f"x\n{a}\n{b}\n{c}\ny")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    rule = brute.passage_lines(rows) | brute.chunk_lines(rows)
    assert not any(i == 3 for i, _ in brute.passage_lines(rows))
    got = {x["doc_id"]: x["removed_lines"] for x in line_dedup.removals(frame, passages=True).collect()}
    assert got == {i: sum(d == i for d, _ in rule) for i, _ in rows}


@pytest.mark.parametrize("block", [8_000_000, 150])
def test_decontaminate(docs, clashing, items, block):
    got = decontaminate.search(docs.select("doc_id", "text"), items, block_chars=block).collect()
    told = brute.contaminated(texts(docs), ITEMS)
    for r in got:
        hit = sum(x["stop"] - x["start"] for x in r["hits"] or ())
        assert (r["n_words"], hit, len(r["items"] or ())) == told[r["doc_id"]][:3]
    clean = decontaminate.decontaminate(clashing, items)
    assert clean.columns == clashing.columns
    assert {r["doc_id"] for r in clean.collect()} == {i for i, v in told.items() if not v[4]}


def test_decontaminate_on_data(spark, small, docs, items):
    columns = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    own = [(r["item_id"], r["text"]) for r in bench.collect()]
    assert found(decontaminate.occurrences(small, bench), *columns) == brute.contaminated(texts(small), own)
    assert decontaminate.occurrences(empty(docs), items).count() == 0
    clean = found(decontaminate.occurrences(docs, empty(items)), "n_hit", "contaminated")
    assert set(clean.values()) == {(0, False)}


def test_token_files(spark, docs, clashing, small, tmp_path):
    tokenizer = Tokenizer.from_file(WORD_BPE)
    columns = ("start", "n_tokens", "ids_crc32")
    for frame in (docs, clashing, small):
        assert found(token_files.encode_and_read(frame, WORD_BPE), *columns) == brute.token_index(
            texts(frame), tokenizer)
    assert token_files.encode_and_read(empty(docs), WORD_BPE).count() == 0
    folder = str(tmp_path / "shards")
    token_files.write(docs, folder, WORD_BPE, shard_tokens=500)
    got = {r["doc_id"]: r["ids"] for r in token_files.fetch(spark, folder, [5, 17]).collect()}
    for i in (5, 17):
        assert got[i] == [*tokenizer.encode(dict(texts(docs))[i], add_special_tokens=False).ids, 1]
    whole = found(token_files.read_index(spark, folder), *columns)
    assert whole == brute.token_index(texts(docs), tokenizer)


def test_token_shard_format():
    import io

    import zstandard

    ids = [(None, b"\1\0"), (3, b"\2\0\3\0"), (9, b"")]
    content = token_files.shard_bytes(1, 2, ids, 2)
    assert content[-1:] == token_files.TAIL
    shard = token_files.Shard(content)
    assert (shard.part, shard.number, shard.doc_ids) == (1, 2, [None, 3, 9])
    assert [shard.tokens(k).tolist() for k in range(3)] == [[1], [2, 3], []]
    # any zstandard reader reads the frames in a row and skips the table
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
    assert plain.endswith(b"\1\0\2\0\3\0")
    broken = bytearray(content)
    broken[int(shard.starts[2]) + 9] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        token_files.Shard(bytes(broken)).tokens(1)


def test_token_files_nulls_and_repeats(spark):
    frame = spark.createDataFrame([(2, "b"), (None, "a"), (2, "b")], "doc_id long, text string")
    got = sorted(token_files.encode_and_read(frame, WORD_BPE).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 2, 2] and [r["start"] for r in got] == [0, 2, 4]


def test_jaccard_join(docs, clashing, small):
    columns = ("class_id", "class_rows", "n_links")
    for frame in (docs, clashing, small):
        assert found(jaccard_join.classes(frame), *columns) == brute.jaccard_classes(texts(frame))
    kept = jaccard_join.deduplicate(clashing)
    assert kept.columns == clashing.columns
    told = brute.jaccard_classes(texts(docs))
    assert {r["doc_id"] for r in kept.collect()} == {i for i, v in told.items() if v[0] == i}
    assert jaccard_join.classes(empty(docs)).count() == 0


def test_jaccard_join_large_group(spark, monkeypatch):
    """A group of near copies beyond one tile and one bucket, with an unrelated text."""
    monkeypatch.setattr(jaccard_join, "TILE", 40)
    monkeypatch.setattr(jaccard_join, "CROWD", 5)
    r = random.Random(9)
    base = [f"w{r.randrange(900)}" for _ in range(150)]
    data = []
    for i in range(150):
        own = list(base)
        for _ in range(r.randrange(4)):
            own[r.randrange(150)] = f"v{r.randrange(10**6)}"
        data.append((i, " ".join(own)))
    data.append((500, " ".join(f"z{k}" for k in range(150))))
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert found(jaccard_join.classes(frame), "class_id", "class_rows", "n_links") == brute.jaccard_classes(data)


def test_jaccard_recall(spark):
    """Pairs close to the threshold are found."""
    r = random.Random(11)
    data = []
    for p in range(300):
        own = [f"p{p}w{k}" for k in range(104)]
        data.append((2 * p, " ".join(own)))
        other = list(own)
        for at in r.sample(range(10, 94), 2):
            other[at] = f"q{p}x{at}"
        data.append((2 * p + 1, " ".join(other)))
    told = brute.jaccard_classes(data)
    frame = spark.createDataFrame(data, "doc_id long, text string")
    got = found(jaccard_join.classes(frame), "class_id", "class_rows", "n_links")
    linked = [i for i, v in told.items() if v[2]]
    assert len(linked) > 300
    assert sum(got[i] == told[i] for i in linked) >= 0.99 * len(linked)
    assert all(got[i] == told[i] for i in told if not told[i][2])


def test_jaccard_crowded_bucket_keeps_pairs():
    """Pairs at the threshold that share a bucket share one of its parts too, sizes equal or not."""
    import numpy as np
    import pyarrow as pa

    r, pairs = random.Random(4), []
    for p in range(300):
        own = [f"p{p}w{k}" for k in range(104)]
        other = own[:84] if p % 2 else [*own[:92], *(f"q{p}x{k}" for k in range(12))]
        pairs += [" ".join(own), " ".join(other)]
    node = [[r.randrange(2**62)] for _ in range(300) for _ in (0, 1)]
    for k in range(300):
        node[2 * k + 1] = node[2 * k]
    batch = pa.record_batch({"text": pa.array(pairs), "paths": pa.array(node, pa.list_(pa.int64()))})
    paths = [x for out in jaccard_join._deeper(iter([batch])) for x in out.column("paths").to_pylist()]
    met = np.array([bool(set(paths[2 * k]) & set(paths[2 * k + 1])) for k in range(300)])
    assert met.mean() >= 0.98


@pytest.mark.parametrize("n", [4, 9, 18, 72, 250])
def test_jaccard_sketches_of_short_sets(spark, n):
    """The last comparison keeps pairs at the threshold, whatever their size."""
    import numpy as np

    r, pairs = np.random.default_rng(n), 1500
    more = n + n // 4 if n % 4 == 0 else n  # one set holds the other, or sizes are equal
    shared = n if more > n else -(-8 * n // 9)
    rows = []
    for _ in range(pairs):
        v = r.integers(0, 2**63, 2 * more, dtype=np.uint64)
        rows += [v[:n], np.concatenate([v[:shared], v[n:n + more - shared]])]
    bits = jaccard_join.all_bits(np.concatenate(rows), np.array([len(x) for x in rows])).to_pylist()
    schema = "n long, bits array<long>, mate struct<n long, bits array<long>>"
    frame = spark.createDataFrame([(len(rows[2 * k]), bits[2 * k], (len(rows[2 * k + 1]), bits[2 * k + 1]))
                                   for k in range(pairs)], schema)
    bar = jaccard_join.SIMILAR - jaccard_join._slack(F.least("n", "mate.n"), jaccard_join.SIMILAR)
    assert frame.where(jaccard_join._alike("mate") < bar).count() <= 1


def test_jaccard_deduplicate_repeated_ids(spark):
    """An id with two texts loses only the row that another row stands for."""
    a, b = (" ".join(f"{c}{k}" for k in range(100)) for c in "ab")
    data = [(3, a), (5, a + " tail"), (5, b), (8, b + " tail"), (5, None), (None, a)]
    kept = jaccard_join.deduplicate(spark.createDataFrame(data, "doc_id long, text string"))
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(3, a), (5, b), (5, None), (None, a)}


def test_jaccard_many_rows_without_id(spark, monkeypatch):
    """Rows without id meet their own text only, not one another."""
    base, counts = [f"b{k}" for k in range(100)], []
    data = [(None, " ".join([*base, f"own{i}"])) for i in range(600)]
    keep = jaccard_join._texts_of

    def counted(docs, wanted):
        counts.append((keep(docs, wanted).count(), wanted.count()))
        return keep(docs, wanted)

    monkeypatch.setattr(jaccard_join, "_texts_of", counted)
    got = jaccard_join.classes(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(got) == 600 and all(r["class_rows"] == 600 and r["n_links"] == 599 for r in got)
    assert counts and all(rows == wanted for rows, wanted in counts)


def test_token_counts(spark, docs, clashing, small):
    tokenizer = Tokenizer.from_file(BYTE_BPE)
    r = random.Random(1)
    bits = [*"ab1 2'  \n\t\r!.éß中 ́　٣²'", "'s", "'re", "'ll", "'t", " '", "<|endoftext|>", "😀"]
    fuzz = spark.createDataFrame([(i, "".join(r.choice(bits) for _ in range(r.randrange(400))))
                                  for i in range(500)], "doc_id long, text string")
    for frame in (docs, clashing, small, fuzz):
        told = {i: (len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids),
                    n > 512) for i, t in texts(frame)}
        assert found(token_counts.token_counts(frame, BYTE_BPE), "n_bytes", "n_tokens", "over_limit") == told
    assert token_counts.token_counts(empty(docs), BYTE_BPE).count() == 0


def test_native_operators_run_no_python(docs, small):
    passages = functools.partial(line_dedup.removals, passages=True)
    for make in (mixing.taken, exact_dedup.classes, line_dedup.removals, passages, pii.find):
        plan = make(small)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_every_operator_is_registered():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))


def test_pipeline(spark):
    import corpus_pipeline

    folder = SMALL
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], folder).cache())
        assert seen[-1].columns == columns, name
    start, chosen, near, clean, mixed = seen
    kept = {r["doc_id"] for r in quality.scores(
        start, quality.graded(spark.read.parquet(f"{folder}/labels.parquet"))).where("kept").collect()}
    assert {r["doc_id"] for r in chosen.collect()} == kept
    told = brute.jaccard_classes(texts(chosen))
    assert {r["doc_id"] for r in near.collect()} == {i for i, v in told.items() if v[0] == i}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    hit = brute.contaminated(texts(near), bench)
    assert {r["doc_id"] for r in clean.collect()} == {i for i, v in hit.items() if not v[4]}
    assert {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in clean.collect()}
    got = sorted(corpus_pipeline.run(spark, folder).collect(), key=lambda r: r["start"])
    tokenizer, at = Tokenizer.from_file(WORD_BPE), 0
    own = dict(texts(start))
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(tokenizer.encode(
            own[r["doc_id"]], add_special_tokens=False).ids) + 1)
        at += r["n_tokens"]
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in mixed.collect())
