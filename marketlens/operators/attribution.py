"""Customer journeys and multi-touch attribution.

A touch is the acquisition itself or one campaign send. (customer, campaign) is the key
of the sends, so a journey is never longer than the number of campaigns plus one. For
crediting, touches are first reduced to customer x channel x day, which bounds every
per-customer window by channels x calendar days whatever the number of sends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions.dates import floor_days
from marketlens.functions.numbers import exact, fixed, ratio, share, zero
from marketlens.plans.tables import Tables

ARROW = " → "
UNCONVERTED_WINDOW_DAYS = 90


def conversions(t: Tables) -> DataFrame:
    """Customers with first-deposit date and amount; NULL date if never converted."""
    first = t.first_deposits.groupBy("customer_id").agg(
        F.min("transaction_date").alias("first_deposit_date"),
        F.sum("amount").alias("first_deposit_amount"))
    return t.customers.select(
        "customer_id", "acquisition_channel", "signup_date", "acquisition_cost",
    ).join(first, "customer_id", "left").withColumns({
        "converted": F.col("first_deposit_date").isNotNull(),
        "first_deposit_amount": zero("first_deposit_amount"),
    })


def touches(t: Tables) -> DataFrame:
    """One row per touch inside the journey window.

    Converted customers: up to the first deposit. Others: up to 90 days after signup.
    ``place`` orders a journey: by date, acquisition first, then campaign id.
    """
    people = conversions(t)
    acquired = people.select(
        "*", F.lit("acquisition").alias("touchpoint_type"),
        F.col("acquisition_channel").alias("channel"), F.col("signup_date").alias("touch_date"),
        F.lit(None).cast("string").alias("campaign_id"), F.lit(True).alias("responded"),
        F.col("acquisition_cost").alias("cost"))
    sends = t.customer_campaigns.join(
        t.campaigns.select("campaign_id", "campaign_type"), "campaign_id")
    sent = people.join(sends, "customer_id").select(
        *people.columns, F.lit("campaign").alias("touchpoint_type"),
        F.col("campaign_type").alias("channel"), F.col("sent_date").alias("touch_date"),
        "campaign_id", "responded", F.col("campaign_cost").cast("decimal(10,2)").alias("cost"))
    limit = F.when(F.col("converted"), F.col("first_deposit_date")).otherwise(
        F.date_add("signup_date", UNCONVERTED_WINDOW_DAYS).cast("timestamp_ntz"))
    place = F.struct(
        "touch_date", (F.col("touchpoint_type") == "campaign").cast("int").alias("kind"),
        F.coalesce("campaign_id", F.lit("")).alias("campaign"))
    return acquired.unionByName(sent).where(
        F.col("touch_date").cast("timestamp_ntz") <= limit).withColumn("place", place)


def journeys(t: Tables) -> DataFrame:
    """One row per customer with the ordered touches as an array of structs."""
    point = F.struct(
        "place", "touchpoint_type", "channel", F.col("touch_date").alias("date"), "campaign_id",
        "responded", "cost")
    gathered = touches(t).groupBy("customer_id").agg(
        F.array_sort(F.collect_list(point)).alias("points"),
        F.sum("cost").alias("total_touchpoint_cost"))
    listed = F.transform("points", lambda p: p.dropFields("place"))
    return conversions(t).join(gathered, "customer_id", "left").select(
        "customer_id", "acquisition_channel", "signup_date", "first_deposit_date",
        "first_deposit_amount", "converted",
        F.coalesce(listed, F.array().cast("array<struct<touchpoint_type:string,channel:string,"
                   "date:date,campaign_id:string,responded:boolean,cost:decimal(10,2)>>"))
        .alias("touchpoints"),
        F.coalesce(F.size("points"), F.lit(0)).alias("num_touchpoints"),
        zero("total_touchpoint_cost").alias("total_touchpoint_cost"))


def journey_paths(t: Tables) -> DataFrame:
    """Journeys with the channel path as text instead of the nested touches."""
    return journeys(t).withColumn(
        "path", F.array_join(F.transform("touchpoints", lambda p: p["channel"]), ARROW)
    ).drop("touchpoints")


# --- credit -------------------------------------------------------------------------------
# A model maps the columns of ``credit_cells`` to the weight of a cell of n touches:
#   n, touches (whole journey), has_first, has_last, age_days, and window-normalised decay.

HALF_LIFE_DAYS = 7
FIRST_WEIGHT = LAST_WEIGHT = 0.4


def position_weight(first: float = FIRST_WEIGHT, last: float = LAST_WEIGHT) -> Column:
    """Two touches share the middle weight; longer journeys spread it between the ends."""
    middle = 1.0 - first - last
    ends = F.col("has_first") * first + F.col("has_last") * last
    inner = F.col("n") - F.col("has_first") - F.col("has_last")
    return (
        F.when(F.col("touches") == 1, F.lit(1.0))
        .when(F.col("touches") == 2, ends + F.col("n") * (middle / 2))
        .otherwise(ends + inner * F.lit(middle) / (F.col("touches") - 2))
    )


MODELS: dict[str, Callable[[], Column]] = {
    "last_click": lambda: F.col("has_last").cast("double"),
    "first_touch": lambda: F.col("has_first").cast("double"),
    "linear": lambda: F.col("n") / F.col("touches"),
    "time_decay": lambda: F.col("decay"),
    "position_based": position_weight,
}


def weights(first: float = FIRST_WEIGHT, last: float = LAST_WEIGHT
            ) -> dict[str, Callable[[], Column]]:
    """The models, with the given weights of the first and the last touch."""
    return {**MODELS, "position_based": lambda: position_weight(first, last)}


ANCHORS = ("last_touch", "conversion")


def credit_cells(t: Tables, half_life: float = HALF_LIFE_DAYS,
                 anchor: str = "last_touch") -> DataFrame:
    """Converted journeys as customer x channel x day cells with what models need.

    Decay is counted back from the last touch or from the first deposit.
    """
    if anchor not in ANCHORS:
        raise ValueError(f"Unknown anchor: {anchor}. Available: {list(ANCHORS)}")
    cells = touches(t).where("converted").groupBy(
        "customer_id", "channel", "touch_date", "first_deposit_amount").agg(
        F.count("*").alias("n"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    journey = Window.partitionBy("customer_id")
    end = F.max("touch_date").over(journey)
    if anchor == "conversion":
        paid = t.first_deposits.groupBy("customer_id").agg(
            F.min("transaction_date").cast("date").alias("paid"))
        cells, end = cells.join(paid, "customer_id"), F.col("paid")
    spread = cells.select(
        "*", F.sum("n").over(journey).alias("touches"),
        (F.col("lo") == F.min("lo").over(journey)).cast("int").alias("has_first"),
        (F.col("hi") == F.max("hi").over(journey)).cast("int").alias("has_last"),
        F.datediff(end, "touch_date").alias("age_days"))
    raw = F.col("n") * F.pow(F.lit(2.0), -F.col("age_days") / F.lit(float(half_life)))
    return spread.withColumn("raw", raw).withColumn(
        "decay", F.col("raw") / F.sum("raw").over(journey)).drop("raw", "lo", "hi")


def attributed(t: Tables, models: dict[str, Callable[[], Column]],
               half_life: float = HALF_LIFE_DAYS, anchor: str = "last_touch") -> DataFrame:
    """Credit per model and channel, all models in one pass over the cells."""
    per_customer = credit_cells(t, half_life, anchor).groupBy("channel", "customer_id").agg(
        F.max("first_deposit_amount").cast("double").alias("value"),
        *[F.sum(weight()).alias(name) for name, weight in models.items()])
    long = per_customer.unpivot(
        ["channel", "customer_id", "value"], list(models), "model", "weight")
    agg = long.where("weight > 0").groupBy("model", "channel").agg(
        F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("value")).alias("v"),
        F.count("*").alias("unique_customers"))
    return agg.select(
        "model", "channel", fixed("w", 6).alias("attributed_conversions"),
        fixed("v", 4).alias("attributed_value"), "unique_customers",
        fixed(F.try_divide("v", "w"), 4).alias("avg_attributed_value"))


def attributed_conversions(t: Tables, model: str = "last_click", *,
                           half_life: float = HALF_LIFE_DAYS, anchor: str = "last_touch",
                           first: float = FIRST_WEIGHT, last: float = LAST_WEIGHT) -> DataFrame:
    if model not in MODELS:
        raise ValueError(f"Unknown model: {model}. Available: {list(MODELS)}")
    return attributed(t, {model: weights(first, last)[model]}, half_life, anchor).drop("model")


def compare_models(t: Tables, *, half_life: float = HALF_LIFE_DAYS, anchor: str = "last_touch",
                   first: float = FIRST_WEIGHT, last: float = LAST_WEIGHT) -> DataFrame:
    return attributed(t, weights(first, last), half_life, anchor).drop("unique_customers")


def compare_pivot(t: Tables) -> DataFrame:
    """Channel x model matrix of attributed conversions, 0 where a model gives none."""
    wide = compare_models(t).groupBy("channel").pivot("model", list(MODELS)).agg(
        F.max("attributed_conversions"))
    return wide.select("channel", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in MODELS])


def channel_costs(t: Tables) -> DataFrame:
    """Touch cost per channel over all journeys, converted or not."""
    return touches(t).groupBy("channel").agg(F.sum("cost").alias("total_cost"))


def attribution_roi(t: Tables, model: str | None = None, *, half_life: float = HALF_LIFE_DAYS,
                    anchor: str = "last_touch", first: float = FIRST_WEIGHT,
                    last: float = LAST_WEIGHT) -> DataFrame:
    """ROI and ROAS per channel for one model, or for all with a model column."""
    if model is not None and model not in MODELS:
        raise ValueError(f"Unknown model: {model}. Available: {list(MODELS)}")
    known = weights(first, last)
    chosen = known if model is None else {model: known[model]}
    joined = attributed(t, chosen, half_life, anchor).join(channel_costs(t), "channel", "left").withColumn(
        "total_cost", zero("total_cost").cast("double"))
    paid, value = F.col("total_cost"), F.col("attributed_value")
    guard = lambda c: F.when(paid > 0, fixed(c, 4)).otherwise(0.0)
    return joined.select(
        "model", "channel", "total_cost", "attributed_value",
        guard(F.try_divide((value - paid) * 100, paid)).alias("roi_percent"),
        guard(F.try_divide(value, paid)).alias("roas_ratio"), "attributed_conversions")


def channel_efficiency(t: Tables) -> DataFrame:
    """Attributed conversions per unit of channel cost."""
    return attribution_roi(t).select(
        "model", "channel", "attributed_conversions", "total_cost",
        fixed(F.try_divide("attributed_conversions", "total_cost"), 8).alias("efficiency"))


def attribution_winners(t: Tables) -> DataFrame:
    """Per model: the strongest channel, the best ROI and ROAS channel, and the total."""
    best = lambda c: F.min(F.struct((-F.col(c)).alias("x"), "channel"))
    return attribution_roi(t).groupBy("model").agg(
        best("attributed_conversions").alias("top"), best("roi_percent").alias("roi"),
        best("roas_ratio").alias("roas"),
        fixed(F.sum("attributed_conversions"), 3).alias("total_conversions"),
    ).select(
        "model", F.col("top.channel").alias("top_channel"),
        (-F.col("top.x")).alias("top_conversions"), F.col("roi.channel").alias("best_roi_channel"),
        F.col("roas.channel").alias("best_roas_channel"), "total_conversions")


# --- journey patterns ---------------------------------------------------------------------

def journey_sizes(t: Tables) -> DataFrame:
    """Number of touches per customer, without gathering them."""
    counted = touches(t).groupBy("customer_id").agg(F.count("*").alias("n"))
    return conversions(t).join(counted, "customer_id", "left").withColumn(
        "num_touchpoints", zero("n"))


def journey_length(t: Tables) -> DataFrame:
    """Mean and median touches; the median buffer holds one entry per distinct length."""
    agg = journey_sizes(t)
    out = []
    for name, test in (("converted", F.col("converted")), ("non_converted", ~F.col("converted"))):
        n = F.when(test, F.col("num_touchpoints"))
        out += [share(F.sum(n), F.count(n), 6).alias(f"avg_touchpoints_{name}"),
                F.median(n).alias(f"median_touchpoints_{name}")]
    return agg.agg(*out)


def journey_patterns(t: Tables, top: int = 10) -> DataFrame:
    """Most frequent channel paths; ties by path."""
    return (
        journey_paths(t).groupBy("path").agg(F.count("*").alias("customers"))
        .orderBy(F.desc("customers"), "path").limit(top)
    )


def conversion_by_length(t: Tables) -> DataFrame:
    return journey_sizes(t).groupBy("num_touchpoints").agg(
        F.count("*").alias("total_customers"), F.count_if("converted").alias("conversions"),
    ).withColumn("conversion_rate", share("conversions", "total_customers", 3))


def time_to_conversion(t: Tables) -> DataFrame:
    """Whole days: the percentile buffer holds at most one entry per day."""
    days = conversions(t).where("converted").select(
        floor_days("signup_date", "first_deposit_date").alias("d"))
    quantile = lambda p: F.percentile("d", F.lit(p))
    return days.agg(
        share(F.sum("d"), F.count("d"), 6).alias("avg_days"), quantile(0.5).alias("median_days"),
        quantile(0.25).alias("p25_days"), quantile(0.75).alias("p75_days"))


def campaign_touch_credit(t: Tables) -> DataFrame:
    """The dashboards' own weights over campaign touches of converted customers.

    Every touch on the first/last touch day earns the conversion value, linear is one
    over the touches, decay runs from the conversion and is not normalised.
    """
    cells = touches(t).where("converted AND touchpoint_type = 'campaign'").groupBy(
        "customer_id", "channel", "touch_date", "first_deposit_date", "first_deposit_amount",
    ).agg(F.count("*").alias("n"))
    journey = Window.partitionBy("customer_id")
    total = F.sum("n").over(journey)
    marked = cells.select(
        "*", total.alias("touches"),
        (F.col("touch_date") == F.max("touch_date").over(journey)).alias("last"),
        (F.col("touch_date") == F.min("touch_date").over(journey)).alias("first"))
    n, value = F.col("n"), F.col("first_deposit_amount")
    age = F.datediff(F.to_date("first_deposit_date"), "touch_date")
    position = F.when(F.col("last") | F.col("first"), F.lit(0.4)).otherwise(
        F.try_divide(F.lit(0.2), (F.col("touches") - 2).cast("double")))
    return marked.groupBy(F.col("channel").alias("campaign_type")).agg(
        F.sum("n").alias("touches"),
        zero(F.sum(F.when(F.col("last"), n * value))).alias("last_touch_value"),
        zero(F.sum(F.when(F.col("first"), n * value))).alias("first_touch_value"),
        fixed(F.sum(n / F.col("touches")), 6).alias("linear_weight"),
        fixed(F.sum(n * F.pow(F.lit(0.5), age / F.lit(7.0))), 6).alias("time_decay_weight"),
        fixed(F.sum(n * position), 6).alias("position_weight"))


def journey_flow(t: Tables) -> DataFrame:
    """How many journeys step from one channel to the next, by step."""
    order = Window.partitionBy("customer_id").orderBy("place")
    steps = touches(t).select(
        "customer_id", "channel", F.row_number().over(order).alias("step"),
        F.lead("channel").over(order).alias("next_channel"))
    return steps.groupBy("step", "channel", F.coalesce("next_channel", F.lit("(end)")).alias(
        "next_channel")).agg(F.count("*").alias("customers"))
