"""Two-variant experiments on conversion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwise.functions.numeric import cents, half_up, money, normal_cdf, ratio
from stallwise.functions.totals import grand_totals

# Variant names and decisions.
CONTROL, TREATMENT = "Control", "Treatment"
ROLLOUT, HOLD = "Strong evidence to test rollout", "Do not roll out yet"

# Normal quantiles for 95 % confidence (two-sided) and 80 % power.
Z_CONFIDENCE = 1.959963984540054
Z_POWER = 0.8416212335729143


def experiment_summary(sessions: DataFrame) -> DataFrame:
    """Totals and rates per variant; cancellations are relative to conversions."""
    return (
        sessions.filter(F.col("variant").isNotNull())
        .groupBy("variant")
        .agg(
            F.count("session_id").alias("sessions"),
            F.sum("converted").alias("conversions"),
            money(F.sum(cents("gmv"))).alias("gmv"),
            F.sum("cancelled").alias("cancellations"),
        )
        .withColumn("conversion_rate", ratio(F.col("conversions"), F.col("sessions")))
        .withColumn("cancel_rate", ratio(F.col("cancellations"), F.col("conversions")))
        .orderBy("variant")
    )


# Headings of the displayed table.
HEADINGS = ("Variant", "Sessions", "Conversions", "GMV", "Cancellations", "Conversion %", "Cancel %")


def experiment_display(sessions: DataFrame) -> DataFrame:
    """The summary as displayed: rates in percent with two decimals."""
    summary = experiment_summary(sessions)
    rates = {c: half_up(F.col(c) * F.lit(100.0), 2) for c in ("conversion_rate", "cancel_rate")}
    return summary.withColumns(rates).toDF(*HEADINGS)


def _arms(sessions: DataFrame, by: list[str]) -> DataFrame:
    """Both variants' totals side by side in one pass; groups lacking either are dropped."""
    columns = []
    for tag, variant in (("c", CONTROL), ("t", TREATMENT)):
        arm = F.col("variant") == variant
        columns += [
            F.count_if(arm & F.col("session_id").isNotNull()).alias(f"n_{tag}"),
            F.sum(F.when(arm, F.col("converted")).otherwise(0)).alias(f"x_{tag}"),
            F.sum(F.when(arm, F.col("cancelled")).otherwise(0)).alias(f"k_{tag}"),
            money(F.sum(F.when(arm, cents("gmv")).otherwise(F.lit(0).cast("long")))).alias(f"gmv_{tag}"),
        ]
    return (
        sessions.groupBy(*by)
        .agg(*columns)
        .filter((F.col("n_c") > 0) & (F.col("n_t") > 0))
        .withColumn("pc", ratio(F.col("x_c"), F.col("n_c")))
        .withColumn("pt", ratio(F.col("x_t"), F.col("n_t")))
    )


def _z_test(arms: DataFrame) -> DataFrame:
    """Pooled two-proportion z and its two-sided p; z is 0 without any variance."""
    n_c, n_t = F.col("n_c").cast("double"), F.col("n_t").cast("double")
    pooled = ratio(F.col("x_c") + F.col("x_t"), F.col("n_c") + F.col("n_t"))
    one = F.lit(1.0)
    return (
        arms.withColumn("se", F.sqrt(pooled * (one - pooled) * (one / n_c + one / n_t)))
        .withColumn("z", F.coalesce(ratio(F.col("pt") - F.col("pc"), F.col("se")), F.lit(0.0)))
        .withColumn("p_value", F.lit(2.0) * (one - normal_cdf(F.abs("z"))))
        .withColumn("lift_pct", F.coalesce((ratio(F.col("pt"), F.col("pc")) - one) * F.lit(100.0), F.lit(0.0)))
        .withColumn("gmv_per_session", F.col("gmv_t") / n_t)
    )


def _decision(p: Column, alpha: float) -> Column:
    return F.when((p < F.lit(alpha)) & (F.col("lift_pct") > 0), ROLLOUT).otherwise(HOLD)


READOUT = ("pc", "pt", "lift_pct", "z", "p_value", "gmv_per_session")


def experiment_readout(sessions: DataFrame, alpha: float = 0.05) -> DataFrame:
    """One row: both conversions, relative lift, z, p, treatment GMV per session and a decision.

    No row when a variant is missing.
    """
    tested = _z_test(_arms(sessions, []))
    return tested.select(*READOUT, _decision(F.col("p_value"), alpha).alias("decision"))


def experiment_by_segment(sessions: DataFrame, segment: str, alpha: float = 0.05) -> DataFrame:
    """The readout per segment, p-values Bonferroni-corrected for the number of segments tested."""
    arms = _arms(sessions.filter(F.col(segment).isNotNull()), [segment])
    tests = grand_totals(arms, "n_c", "n_t", "x_c", "x_t", "gmv_t").getField("groups")
    return (
        _z_test(arms)
        .select(segment, *READOUT)
        .withColumn("p_adjusted", F.least(F.lit(1.0), F.col("p_value") * tests))
        .withColumn("decision", _decision(F.col("p_adjusted"), alpha))
    )


def experiment_guardrails(sessions: DataFrame) -> DataFrame:
    """Treatment against control on the measures that must not get worse."""
    arms = _arms(sessions, [])
    cancel = [ratio(F.col(f"k_{a}"), F.col(f"x_{a}")) for a in "ct"]
    value = [ratio(F.col(f"gmv_{a}"), F.col(f"n_{a}")) for a in "ct"]
    rows = F.array(
        *(
            F.struct(
                F.lit(name).alias("guardrail"),
                control.alias("control"),
                treatment.alias("treatment"),
                (treatment - control).alias("difference"),
                (worse(control, treatment)).alias("deteriorated"),
            )
            for name, (control, treatment), worse in (
                ("cancel_rate", cancel, lambda c, t: t > c),
                ("gmv_per_session", value, lambda c, t: t < c),
            )
        )
    )
    return arms.select(F.inline(rows))


def experiment_ci(sessions: DataFrame, z: float = Z_CONFIDENCE) -> DataFrame:
    """Confidence interval of the difference in conversion (unpooled)."""
    one = F.lit(1.0)
    pc, pt = F.col("pc"), F.col("pt")
    margin = F.lit(z) * F.sqrt(pc * (one - pc) / F.col("n_c") + pt * (one - pt) / F.col("n_t"))
    return _arms(sessions, []).select(
        "pc",
        "pt",
        (pt - pc).alias("difference"),
        (pt - pc - margin).alias("ci_low"),
        (pt - pc + margin).alias("ci_high"),
    )


def experiment_power(
    sessions: DataFrame, segment: str, mde: float = 0.02, z_alpha: float = Z_CONFIDENCE, z_beta: float = Z_POWER
) -> DataFrame:
    """Sessions per variant needed to see an absolute lift of ``mde``, against those observed."""
    arms = _arms(sessions.filter(F.col(segment).isNotNull()), [segment])
    p1 = F.col("pc")
    p2 = F.least(F.lit(1.0), p1 + F.lit(mde))
    one = F.lit(1.0)
    variance = p1 * (one - p1) + p2 * (one - p2)
    needed = F.ceil(F.lit((z_alpha + z_beta) ** 2) * variance / F.lit(mde * mde))
    return arms.select(
        segment,
        F.col("n_c").alias("control_sessions"),
        F.col("n_t").alias("treatment_sessions"),
        "pc",
        needed.alias("required_per_variant"),
        (F.least("n_c", "n_t") >= needed).alias("powered"),
    )
