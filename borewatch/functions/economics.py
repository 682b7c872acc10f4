"""Pricing of an alert: loss, pump life, intervention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from borewatch.functions.fixed import ACTIONS, CAUSAL_CHAINS, INCIDENTS, NO_INCIDENT, URGENCY
from borewatch.functions.severity import round_settled, round_tie_even

# Prices and costs in USD.
OIL_PRICE = 80.0
WATER_LIFTING_COST = 4.5
PUMP_WORKOVER_COST = 3_500_000.0
RESTART_COST = 50_000.0
STUDY_COST = 20_000.0


def economic_impact(price: float = OIL_PRICE) -> Column:
    """Lost oil and excess water of a reading against base_<feature>, priced per day."""
    oil_loss = F.greatest(F.lit(0.0), F.col("base_oil_rate_bopd") - F.col("oil_rate_bopd"))
    excess_cut = F.greatest(F.lit(0.0), F.col("water_cut_pct") - F.col("base_water_cut_pct"))
    liquid = F.col("base_oil_rate_bopd") / F.greatest(F.lit(0.01), 1 - F.col("base_water_cut_pct") / 100)
    water = (excess_cut / 100) * liquid
    revenue = oil_loss * price
    handling = water * WATER_LIFTING_COST
    parts = F.array_compact(
        F.array(
            F.when(
                oil_loss > 0,
                F.format_string(f"%.0f BOPD lost @ ${price:.0f}/bbl = $%,.0f/day", F.rint(oil_loss), F.rint(revenue)),
            ),
            F.when(
                water > 0,
                F.format_string(
                    "%.0f bbl/day excess water handling = $%,.0f/day", F.rint(water), F.rint(handling)
                ),
            ),
        )
    )
    details = F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise("Operational impact unquantified")
    return F.struct(
        round_settled(revenue + handling, 2).alias("revenue_at_risk_usd_per_day"),
        round_settled(oil_loss, 1).alias("oil_loss_bopd"),
        round_settled(water, 1).alias("water_excess_bbl_per_day"),
        details.alias("details"),
    )


def whole(column: Column) -> Column:
    """Integer text, ties to even."""
    return F.format_string("%.0f", F.rint(column))


def whole_with_commas(column: Column) -> Column:
    return F.format_string("%,.0f", F.rint(column))


def lookup(column: Column, table: dict, default) -> Column:
    """Value of a small fixed table; lists become arrays."""

    def literal(value) -> Column:
        return F.array(*[F.lit(v) for v in value]) if isinstance(value, list) else F.lit(value)

    expr = None
    for key, value in table.items():
        expr = F.when(column == key, literal(value)) if expr is None else expr.when(column == key, literal(value))
    return expr.otherwise(literal(default))


def _reading(values: Column, feature: str, default=0.0) -> Column:
    return F.coalesce(values[feature], default if isinstance(default, Column) else F.lit(default))


def production_loss(kind: Column, current: Column, baseline: Column) -> Column:
    """Daily and cumulated loss; 15 % of baseline revenue where no oil is lost directly."""
    oil_base = _reading(baseline, "oil_rate_bopd")
    oil_loss = F.greatest(F.lit(0.0), oil_base - _reading(current, "oil_rate_bopd"))
    cut_base = _reading(baseline, "water_cut_pct")
    cut_rise = F.greatest(F.lit(0.0), _reading(current, "water_cut_pct") - cut_base)
    liquid = F.when(cut_base < 99, oil_base / F.greatest(F.lit(0.01), 1 - cut_base / 100)).otherwise(oil_base)
    water = (cut_rise / 100) * liquid
    revenue = oil_loss * OIL_PRICE
    handling = water * WATER_LIFTING_COST
    indirect = (oil_loss < 5) & (kind != "oil_rate_collapse")
    direct_total = revenue + handling
    total = F.when(indirect, F.greatest(direct_total, oil_base * OIL_PRICE * 0.15)).otherwise(direct_total)
    price = f"${OIL_PRICE:.0f}/bbl"
    indirect_text = F.concat(
        F.lit("Indirect cost estimate: 15% of baseline revenue ($"), whole(oil_base),
        F.lit(f" BOPD × {price} × 15% OPEX uplift)"),
    )
    direct_text = F.concat(
        F.lit("Oil rate decline: "), whole(oil_loss), F.lit(f" BOPD × {price} = $"), whole_with_commas(revenue),
        F.lit("/day"),
        F.when(
            water > 0,
            F.concat(
                F.lit("; water handling uplift: "), whole(water),
                F.lit(f" bbl/day × ${WATER_LIFTING_COST:.2f}/bbl = $"), whole_with_commas(handling), F.lit("/day"),
            ),
        ).otherwise(F.lit("")),
    )
    return F.struct(
        round_tie_even(oil_loss, 1).alias("daily_oil_loss_bopd"),
        round_tie_even(revenue, 2).alias("daily_revenue_usd"),
        round_tie_even(handling, 2).alias("daily_water_cost_uplift_usd"),
        round_tie_even(total, 2).alias("total_daily_impact_usd"),
        round_tie_even(total * 30, 2).alias("cumulative_30day_usd"),
        round_tie_even(total * 90, 2).alias("cumulative_90day_usd"),
        (round_tie_even(total, 2) * 365).alias("annualised_usd"),
        F.when(indirect, indirect_text).otherwise(direct_text).alias("basis"),
    )


def pump_life(current: Column, baseline: Column, days: Column, today: Column | None = None) -> Column:
    """Days until 35 % degradation at the present rate, or null where no pump sign shows."""
    bhp_now = _reading(current, "bhp_psi")
    bhp_base = _reading(baseline, "bhp_psi", bhp_now)
    oil_base = baseline["oil_rate_bopd"]
    bhp_decline = F.greatest(F.lit(0.0), F.try_divide(bhp_base - bhp_now, bhp_base) * 100)
    oil_decline = F.greatest(
        F.lit(0.0),
        (F.coalesce(oil_base, F.lit(0.0)) - _reading(current, "oil_rate_bopd"))
        / F.greatest(F.lit(1.0), F.coalesce(oil_base, F.lit(1.0)))
        * 100,
    )
    degradation = F.greatest(bhp_decline, oil_decline * 0.7)
    rate = degradation / F.greatest(F.lit(1), days)
    life = F.least(
        F.floor(F.greatest(F.lit(0.0), 35.0 - degradation) / F.greatest(F.lit(0.1), rate)), F.lit(365)
    ).cast("int")
    signs = F.array_compact(
        F.array(
            F.when(
                bhp_decline > 5,
                F.concat(
                    F.format_string("BHP declined %.1f%% from baseline (", bhp_decline), whole(bhp_base), F.lit(" → "),
                    whole(bhp_now), F.lit(" psi)"),
                ),
            ),
            F.when(oil_decline > 10, F.format_string("Oil rate declined %.1f%% from baseline", oil_decline)),
            F.format_string("Sustained anomaly for %d days", days),
        )
    )
    estimate = F.struct(
        life.alias("estimated_rul_days"),
        F.when(days >= 7, "HIGH").when(days >= 3, "MEDIUM").otherwise("LOW").alias("confidence"),
        round_tie_even(rate, 3).alias("degradation_rate_pct_per_day"),
        signs.alias("key_indicators"),
        F.date_format(F.date_add(today if today is not None else F.current_date(), life), "yyyy-MM-dd").alias(
            "intervention_deadline"
        ),
    )
    return F.when((bhp_base >= 100) & ((bhp_decline >= 5) | (oil_decline >= 10)), estimate)


def causal_chain(kind: Column, current: Column, baseline: Column) -> Column:
    """Ordered hypothesis lines; types without their own chain get the multi-feature one."""

    def line(text: str) -> Column:
        if "{" not in text:
            return F.lit(text)
        head, rest = text.split("{", 1)
        feature, tail = rest.split("}", 1)
        unit = F.lit("%") if feature == "water_cut_pct" else F.lit("")
        return F.concat(
            F.lit(head), whole(_reading(baseline, feature)), unit, F.lit(" → "),
            whole(_reading(current, feature)), unit, F.lit(tail),
        )

    expr = None
    for name, lines in CAUSAL_CHAINS.items():
        if name == "multi_feature_correlated":
            continue
        chain = F.array(*[line(text) for text in lines])
        expr = F.when(kind == name, chain) if expr is None else expr.when(kind == name, chain)
    return expr.otherwise(F.array(*[F.lit(text) for text in CAUSAL_CHAINS["multi_feature_correlated"]]))


def comparable_incidents(kind: Column) -> Column:
    return lookup(kind, INCIDENTS, [NO_INCIDENT])


def intervention(kind: Column, loss: Column, life: Column, days: Column) -> Column:
    """Urgency, actions, cost, benefit, break-even days and confidence."""
    actions = lookup(kind, ACTIONS, ACTIONS["multi_feature_correlated"])
    rul = life["estimated_rul_days"]
    urgency = F.when(
        kind == "bhp_depletion", F.when(F.coalesce(rul < 30, F.lit(False)), "URGENT").otherwise("PLANNED")
    ).otherwise(lookup(kind, URGENCY, "PLANNED"))
    cost = (
        F.when(
            (kind == "bhp_depletion") & life.isNotNull(),
            F.when(rul < 60, F.lit(PUMP_WORKOVER_COST)).otherwise(F.lit(PUMP_WORKOVER_COST * 0.3)),
        )
        .when(kind == "oil_rate_collapse", F.lit(RESTART_COST))
        .otherwise(F.lit(STUDY_COST))
    )
    benefit = loss["total_daily_impact_usd"]
    payback = F.when(benefit > 0, cost / F.greatest(F.lit(1.0), benefit)).otherwise(F.lit(999.0))
    evidence = F.array_compact(
        F.array(
            F.when(days > 0, F.format_string("Anomaly sustained for %d consecutive days", days)),
            F.when(
                loss["daily_oil_loss_bopd"] > 0,
                F.concat(F.lit("Estimated oil loss: "), whole(loss["daily_oil_loss_bopd"]), F.lit(" BOPD")),
            ),
            F.when(
                life.isNotNull(),
                F.format_string("ESP RUL estimate: %d days (%s confidence)", rul, life["confidence"]),
            ),
        )
    )
    return F.struct(
        urgency.alias("urgency"),
        actions[0].alias("primary_action"),
        F.slice(actions, F.lit(2), F.size(actions)).alias("secondary_actions"),
        cost.alias("estimated_cost_usd"),
        benefit.alias("estimated_benefit_usd_per_day"),
        round_tie_even(payback, 1).alias("roi_days"),
        evidence.alias("supporting_evidence"),
        F.least(F.lit(0.95), 0.4 + days * 0.08).alias("confidence"),
    )


def assess_impact(df: DataFrame, days: str = "consecutive_days", today: Column | None = None) -> DataFrame:
    """Alerts -> alerts with loss, pump life, causal chain, comparables and intervention.

    Needs anomaly_type, current_values and baseline_values; pure projection, no shuffle.
    """
    kind, current, baseline = F.col("anomaly_type"), F.col("current_values"), F.col("baseline_values")
    pump_types = kind.isin("bhp_depletion", "oil_rate_collapse")
    priced = df.withColumns(
        {
            "production_loss": production_loss(kind, current, baseline),
            "esp_rul": F.when(pump_types, pump_life(current, baseline, F.col(days), today)),
            "causal_chain": causal_chain(kind, current, baseline),
            "comparable_incidents": comparable_incidents(kind),
        }
    )
    return priced.withColumn(
        "recommendation", intervention(kind, F.col("production_loss"), F.col("esp_rul"), F.col(days))
    )
