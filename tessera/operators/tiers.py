"""Storage tiers of vectors: factors, prohibitions, scores, hysteresis, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights, saturations and margins of the policy.
HOT = {"recency": 0.20, "access": 0.30, "criticality": 0.25, "latency": 0.25}
WARM = {"recency": 0.05, "access": 0.10, "criticality": 0.05, "latency": 0.05, "age": 0.40, "dormancy": 0.35}
COLD = {"age": 0.35, "dormancy": 0.65}
AGE_DAYS, ACCESSES, DORMANT_DAYS = 180, 20, 120
PROMOTE, DEMOTE, RESIDENCE_DAYS = 0.10, 0.15, 7
MULTIPLIER = {"hot": 1.0, "warm": 0.4, "cold": 0.05}
BYTES = {"hot": 4, "warm": 1, "cold": 4}
LEVEL = {"low": 0.0, "medium": 0.5, "high": 1.0}
ORDER = ("hot", "warm", "cold")


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def _level(c: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LEVEL.items() for x in pair]), F.col(c)), F.lit(0.0))


def factors(state: DataFrame) -> DataFrame:
    """Adds the six factors, each from 0 to 1, from age_days, idle_days (null: never used), accesses, criticality and latency."""
    idle = F.coalesce("idle_days", "age_days")
    return state.withColumns({
        "age": F.round(_unit(F.col("age_days") / AGE_DAYS), 6), "recency": F.round(_unit(1 - idle / DORMANT_DAYS), 6), "access": F.round(_unit(F.col("accesses") / ACCESSES), 6),
        "dormancy": F.round(_unit(idle / DORMANT_DAYS), 6), "critical": _level("criticality"), "fast": _level("latency"),
    })


def prohibited(state: DataFrame) -> DataFrame:
    """Adds ``no_hot``, ``no_warm``, ``no_cold``: the reason that rules a tier out, or null."""
    cold = F.when(F.col("latency") == "high", "LOW_LATENCY").when(F.col("criticality") == "high", "CRITICAL").when(F.col("legal_hold"), "LEGAL_HOLD").when(F.col("retention_days") > 0, "RETENTION")
    return state.withColumns({"no_hot": F.when(F.col("sensitivity") == "restricted", "SENSITIVITY"), "no_warm": F.lit(None).cast("string"), "no_cold": cold})


def routed(state: DataFrame) -> DataFrame:
    """Adds the scores, ``best``, ``selected`` after hysteresis and its ``reason``."""
    named = {"recency": "recency", "access": "access", "criticality": "critical", "latency": "fast", "age": "age", "dormancy": "dormancy"}
    out = prohibited(factors(state))

    def score(tier: str, weights: dict[str, float]) -> Column:
        total = F.lit(0.0)
        for k, w in weights.items():
            total = total + w * F.col(named[k])
        return F.when(F.col(f"no_{tier}").isNotNull(), 0.0).otherwise(F.round(total, 6))

    out = out.withColumns({f"{t}_score": score(t, w) for t, w in zip(ORDER, (HOT, WARM, COLD), strict=True)})
    top = F.array_max(F.array(*[F.struct(F.col(f"no_{t}").isNull().alias("ok"), F.col(f"{t}_score").alias("s"), F.lit(-i).alias("turn"), F.lit(t).alias("tier")) for i, t in enumerate(ORDER)]))
    out = out.withColumn("_top_", top).withColumn("best", F.when(F.col("_top_")["ok"], F.col("_top_")["tier"])).drop("_top_")

    def of(column: str, suffix: str) -> Column:
        return F.coalesce(*[F.when(F.col(column) == t, F.col(f"{t}_score" if suffix == "score" else f"no_{t}")) for t in ORDER])

    gain = F.round(of("best", "score") - of("current_tier", "score"), 6)
    rank = {c: F.array_position(F.array(*map(F.lit, ORDER)), F.col(c)) for c in ("best", "current_tier")}
    margin = F.when(rank["best"] < rank["current_tier"], PROMOTE).otherwise(DEMOTE)
    reason = (
        F.when(F.col("current_tier").isNull(), "INITIAL").when(of("current_tier", "reason").isNotNull(), "FORCED").when(F.col("best") == F.col("current_tier"), "STAY")
        .when(F.col("resident_days") < RESIDENCE_DAYS, "RESIDENCE").when(gain < margin, "MARGIN").otherwise("MOVE")
    )
    out = out.withColumn("reason", reason)
    return out.withColumn("selected", F.when(F.col("reason").isin("INITIAL", "FORCED", "MOVE"), F.col("best")).otherwise(F.col("current_tier")))


def cost(state: DataFrame, dim: int) -> DataFrame:
    """(tier, n, bytes, cost, relative): footprint by tier and its cost against all in the first tier."""
    tiers = state.sparkSession.createDataFrame([(t, BYTES[t], MULTIPLIER[t]) for t in ORDER], "tier string, width int, multiplier double")
    counts = state.groupBy(F.col("current_tier").alias("tier")).agg(F.count("*").alias("n"))
    rows = F.broadcast(tiers).join(counts, "tier", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    size = F.col("n") * dim * F.col("width")
    return rows.select("tier", "n", size.alias("bytes"), F.round(size * F.col("multiplier"), 6).alias("cost"), F.when(F.col("n") > 0, F.round(size * F.col("multiplier") / (F.col("n") * dim * BYTES["hot"]), 6)).otherwise(0.0).alias("relative"))
