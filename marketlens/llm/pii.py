"""Personal data by candidate gradient boosting, without Python on the executors.

Base spans follow fixed patterns and checks and always stay. High-recall generators propose
further, overlapping spans of each kind: addresses with a written-out at sign or dots, and
all runs of digits with separators. Boosted trees (Spark ML) score a proposal by its format
(digits, groups, separators, check digit, octets) and its context (neighbouring characters,
words before it). They are trained on what the checks tell: proposals that agree with a
base span against those that fail the check of their kind, each with the number of proposals
that look like it as its weight. Proposals that no check decides are neither. On the half held out, the
lowest score at which at least ``PRECISION`` of the proposals of a kind are right, over at
least ``SUPPORT`` of them, becomes the threshold of the kind; a kind without such a score
adds nothing. An added span never overlaps a base span.

Positions come from splitting a text at a pattern: gaps and matches add up. Patterns are
bound to the start of a run or the end of the match before, so that a long run is read once.

Edge cases: a null text counts as empty, without spans. Repeated rows and rows without id
get the same spans each by themselves. Without proposals of both sorts no model is trained
and only base spans are given. Other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.shared import stored

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
# the four base patterns, each equal to the plain form but read once
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"\x20?(?:\(at\)|\[at\]|\{at\}|@)\x20?", r"\x20?(?:\.|\(dot\)|\[dot\]|\{dot\})\x20?"
PROPOSE = {
    "address": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++{_AT}{_HOST}++(?:{_DOT}{_HOST}++)++",
    "number": r"[+(]?[0-9](?:[\x20().\x2F-]{0,3}+[0-9])++",
}
CONTEXT = 24
WORDS_BEFORE = {
    "email": "mail|contact|write|@", "ip": "ip|host|server|address|node",
    "card": "card|visa|payment|account|credit", "phone": "phone|tel|call|mobile|fax|dial",
}
PRECISION, SUPPORT, TREES, DEPTH, SEED = 0.98, 20, 10, 3, 7

LEAST_DIGITS = 7  # of a proposed number


def _cut(text: Column, pattern: str) -> Column:
    """Gaps and matches in order; the last gap has no match. Null if nothing matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.struct(
        F.length(p).alias("gap"), F.right(p, F.lit(CONTEXT)).alias("before"),
        F.left(p, F.lit(CONTEXT)).alias("head")))
    return F.arrays_zip(gaps.alias("g"), found.alias("m"))


def _scanned(docs: DataFrame) -> DataFrame:
    """doc_id, a row number, and the cuts of the text by every pattern."""
    text = F.coalesce("text", F.lit(""))
    needs = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"),
             "card": text.rlike("[0-9]"), "phone": text.contains("+"),
             "address": text.rlike(r"[(\[{]at[)\]}]|@"), "number": text.rlike("[0-9]")}
    cuts = [F.when(needs[name], _cut(text, pattern)).alias(name)
            for name, pattern in {**BASE, **PROPOSE}.items()]
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                              F.monotonically_increasing_id().alias("rid"), *cuts), "pii-cuts")


def _placed(scanned: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """rid, what, at, start, stop, m, before, after of every match of the named patterns."""
    rows = reduce(DataFrame.unionByName, [
        scanned.where(F.size(name) > 1).select(
            "rid", F.lit(name).alias("what"), F.posexplode(name).alias("at", "piece"))
        .select("rid", "what", "at", "piece.g.gap", "piece.g.before", "piece.g.head", "piece.m")
        for name in names])
    order = Window.partitionBy("rid", "what").orderBy("at")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    size = F.coalesce(F.length("m"), F.lit(0))
    return (rows.withColumn("stop", F.sum(F.col("gap") + size).over(run).cast("long"))
            .withColumn("after", F.lead("head").over(order))
            .where("m IS NOT NULL").withColumn("start", F.col("stop") - F.length("m")))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _octets(m: Column) -> Column:
    """Whether the parts between dots are at most 255."""
    bare = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    return F.forall(bare, lambda p: F.when(F.length(p) <= 3, p.try_cast("int") <= 255).otherwise(False))


def _passes(kind: Column, m: Column) -> Column:
    n = F.length(_digits(m))
    return (F.when(kind == "ip", _octets(m))
            .when(kind == "card", F.when(n.between(13, 19), F.call_function("luhn_check", _digits(m))).otherwise(False))
            .when(kind == "phone", n.between(9, 15)).otherwise(True))


def base_spans(scanned: DataFrame) -> DataFrame:
    rows = _placed(scanned, KINDS)
    return rows.where(_passes(F.col("what"), F.col("m"))).select(
        "rid", F.col("what").alias("kind"), "start", "stop")


def proposals(scanned: DataFrame) -> DataFrame:
    """Overlapping proposals: the same run of digits may be put up for several kinds."""
    rows = _placed(scanned, tuple(PROPOSE))
    m, n = F.col("m"), F.length(_digits(F.col("m")))
    kinds = F.when(F.col("what") == "address", F.array(F.lit("email"))).otherwise(
        F.array_compact(F.array(
            F.when(m.rlike(r"^[0-9]+(\.[0-9]+){3}$"), F.lit("ip")),
            F.when(n.between(12, 19), F.lit("card")),
            F.when(n.between(LEAST_DIGITS, 15), F.lit("phone")))))
    return rows.select("rid", "start", "stop", "m", "before", "after",
                       F.explode(kinds).alias("kind"))


def features(rows: DataFrame) -> tuple[DataFrame, list[str]]:
    """Format and context features as columns f_*."""
    m, before, after = F.col("m"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    digits, groups = _digits(m), F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    sizes = F.transform(groups, lambda g: F.length(g))
    count = {c: F.length(m) - F.length(F.replace(m, F.lit(c), F.lit("")))
             for c in (" ", "-", ".", "(", "+")}
    near = [F.when(F.col("kind") == k, F.lower(before).rlike(w)) for k, w in WORDS_BEFORE.items()]
    made = {
        "kind": F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")),
        "length": F.length(m), "digits": F.length(digits), "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(sizes), F.lit(0)),
        "shortest": F.coalesce(F.array_min(sizes), F.lit(0)),
        "spaces": count[" "], "hyphens": count["-"], "dots": count["."], "parens": count["("],
        "plus": count["+"],
        "luhn": F.when(F.length(digits).between(12, 19), F.call_function("luhn_check", digits)).otherwise(False),
        "octets": F.when(m.rlike(r"^[0-9]+(\.[0-9]+){3}$"), _octets(m)).otherwise(False),
        "written": m.rlike(r"[\[({]"),
        "lead": F.coalesce(F.substring(digits, 1, 1).try_cast("int"), F.lit(-1)),
        "word": F.coalesce(*near, F.lit(False)),
        "joined_left": before.rlike(r"[A-Za-z0-9_=\x22\x2F#]$"),
        "joined_right": after.rlike(r"^[A-Za-z0-9_%\x22\x2F]"),
        "opens": before.rlike(r"[:(]\s*$"),
    }
    names = [f"f_{n}" for n in made]
    return rows.withColumns({f"f_{n}": F.coalesce(c.cast("double"), F.lit(0.0))
                             for n, c in made.items()}), names


def _overlap(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Proposals with ``same`` (a base span of their kind is equal) and ``over`` (one overlaps)."""
    marks = rows.withColumn("is_base", F.lit(False)).unionByName(
        base.withColumn("is_base", F.lit(True)), allowMissingColumns=True)
    own = F.col("is_base")
    up = Window.partitionBy("rid").orderBy("start", F.desc("is_base")).rowsBetween(
        Window.unboundedPreceding, -1)
    down = Window.partitionBy("rid").orderBy(F.desc("start"), "is_base").rowsBetween(
        Window.unboundedPreceding, -1)
    same = Window.partitionBy("rid", "kind", "start", "stop")
    return (marks.withColumn("left", F.max(F.when(own, F.col("stop"))).over(up))
            .withColumn("right", F.min(F.when(own, F.col("start"))).over(down))
            .withColumn("same", F.max(own.cast("int")).over(same) == 1)
            .where(~own).drop("is_base")
            .withColumn("over", F.coalesce(F.col("left") > F.col("start"), F.lit(False))
                        | F.coalesce(F.col("right") < F.col("stop"), F.lit(False)) | F.col("same")))


def _scored(model: GBTClassificationModel, rows: DataFrame, names: list[str]) -> DataFrame:
    put = VectorAssembler(inputCols=names, outputCol="x").transform(rows)
    return model.transform(put).withColumn(
        "score", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability")


def train(told: DataFrame, names: list[str]) -> tuple[GBTClassificationModel, dict[str, float]] | None:
    """The trees, and the threshold of each kind that has one, from all of ``told``."""
    order = F.xxhash64("rid", "start", "kind", F.lit(SEED))
    # proposals that look alike are one row with their number
    seen = stored(told.withColumn("held", F.pmod(order, F.lit(2)) == 1)
                  .groupBy("kind", "label", "held", *names).agg(F.count("*").cast("double").alias("alike")), "pii-told")
    present = seen.where("NOT held").agg(F.min("label"), F.max("label")).first()
    if present[0] != 0.0 or present[1] != 1.0:
        return None
    model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="alike", maxIter=TREES,
                          maxDepth=DEPTH, maxBins=16, seed=SEED).fit(
        VectorAssembler(inputCols=names, outputCol="x").transform(seen.where("NOT held")))
    held = _scored(model, seen.where("held"), names)
    # summed up by distinct score, of which a few small trees have few, before they are put in order
    level = Window.partitionBy("kind").orderBy(F.desc("score"))
    curve = (held.groupBy("kind", "score").agg(
        F.sum(F.col("label") * F.col("alike")).alias("good"), F.sum("alike").alias("n"))
             .withColumn("good", F.sum("good").over(level)).withColumn("n", F.sum("n").over(level)))
    cuts = curve.where((F.col("good") >= PRECISION * F.col("n")) & (F.col("good") >= SUPPORT)
                       & (F.col("score") > 0.5)).groupBy("kind").agg(F.min("score"))
    return model, {r[0]: r[1] for r in cuts.collect()}


def added_spans(scanned: DataFrame, base: DataFrame) -> DataFrame:
    """rid, kind, start, stop, score of the spans that the trees add."""
    rows, names = features(_overlap(proposals(scanned), base))
    rows = stored(rows, "pii-proposals")
    fails = ~_passes(F.col("kind"), F.col("m"))
    told = rows.withColumn("label", F.when(F.col("same"), 1.0).when(
        F.col("over") | fails, 0.0)).where("label IS NOT NULL")
    trained = train(told, names)
    if trained is None or not trained[1]:
        return rows.where("false").select("rid", "kind", "start", "stop", F.lit(0.0).alias("score"))
    model, cuts = trained
    cut = reduce(lambda c, k: c.when(F.col("kind") == k, cuts[k]), cuts, F)
    chosen = _scored(model, rows.where(~F.col("over")), names).where(F.col("score") >= cut)
    best = Window.partitionBy("rid", "start").orderBy(F.desc("score"), "kind")
    return (chosen.withColumn("first", F.row_number().over(best)).where("first = 1")
            .select("rid", "kind", "start", "stop", "score"))


def _listed(spans: Column) -> Column:
    parts = F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), s["order"]), s["start"], s["stop"]))
    return F.array_join(parts, ",")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_added."""
    scanned = _scanned(docs)
    base = stored(base_spans(scanned), "pii-base")
    everything = base.withColumn("base", F.lit(True)).unionByName(
        added_spans(scanned, base).drop("score").withColumn("base", F.lit(False)))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    span = F.struct(order.alias("order"), "start", "stop")
    own = F.col("base")
    per_row = everything.groupBy("rid").agg(
        *(F.count(F.when(own & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS),
        _listed(F.collect_list(F.when(own, span))).alias("base_text"),
        _listed(F.collect_list(span)).alias("spans"), F.count(F.when(~own, 1)).alias("n_added"))
    zero = F.lit(0).cast("long")
    return scanned.select("rid", "doc_id").join(per_row, "rid", "left").select(
        "doc_id", *(F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS),
        F.sha2(F.coalesce("base_text", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_added", zero).alias("n_added"))
