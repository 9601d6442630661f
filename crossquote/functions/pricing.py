"""Spread, sizing and expected-value arithmetic as Column expressions (all doubles)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
MIN_SPREAD = 0.02
MIN_CONFIDENCE = 0.35
BANKROLL = 10_000.0
HALF_KELLY = 0.5
MAX_FRACTION = 0.10
FEE = 0.02
LIQUIDITY_SHARE = 0.10
LIMIT_STEP = 0.01
BUY_B, BUY_A = "buy_b_sell_a", "buy_a_sell_b"
# ----------------------------------------------------------- end of fixed values


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def direction(price_a: Column, price_b: Column) -> Column:
    """Which side is cheap; equal prices count as buying b."""
    return F.when(price_a >= price_b, BUY_B).otherwise(BUY_A)


def raw_spread(price_a: Column, price_b: Column) -> Column:
    return F.round(F.abs(price_a - price_b), 6)


def guaranteed_spread(yes_a: Column, no_a: Column, yes_b: Column, no_b: Column) -> Column:
    """Locked-in profit of the cheaper of the two Yes+No combinations, never below 0."""
    return F.round(F.greatest(F.lit(1.0) - F.least(yes_b + no_a, yes_a + no_b), F.lit(0.0)), 6)


def yes_price(prices: Column) -> Column:
    """Price under YES, yes or Yes, else the first listed price, else 0.5."""
    named = [F.try_element_at(prices, F.lit(k)) for k in ("YES", "yes", "Yes")]
    return F.coalesce(*named, F.get(F.map_values(prices), F.lit(0)), F.lit(0.5))


def no_price(prices: Column, yes: Column) -> Column:
    named = [F.try_element_at(prices, F.lit(k)) for k in ("NO", "no")]
    return F.coalesce(*named, F.round(F.lit(1.0) - yes, 6))


def volume_ratio(a: Column, b: Column) -> Column:
    return F.round(F.least(F.when(b > 0, F.try_divide(a, b)).otherwise(F.lit(10.0)), F.lit(10.0)), 4)


def days_to_close(close: Column, as_of: Column) -> Column:
    """Fractional days until close, 0 when past, 365 when unknown."""
    seconds = F.unix_micros(close.cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))
    days = F.round(F.greatest(seconds / F.lit(86_400_000_000.0), F.lit(0.0)), 2)
    return F.when(close.isNotNull(), days).otherwise(365.0)


def convergence_heuristic(current, velocity, z, days, ratio) -> Column:
    """Rule score of P(converge); ``current`` keeps its sign (see ``abs_features`` in scoring)."""
    size = F.when(current > 0.10, 0.15).when(current > 0.05, 0.08).otherwise(0.0)
    unusual = F.when(F.abs(z) > 2.0, 0.12).when(F.abs(z) > 1.0, 0.06).otherwise(0.0)
    trend = F.when(velocity < -0.005, 0.10).when(velocity > 0.005, -0.08).otherwise(0.0)
    horizon = F.when(days < 7, 0.05).when(days > 180, -0.05).otherwise(0.0)
    balance = F.when(ratio.between(0.3, 3.0), 0.05).otherwise(0.0)
    return F.round(clamp(F.lit(0.5) + size + unusual + trend + horizon + balance, 0.01, 0.99), 4)


def match_quality(similarity: Column, guaranteed: Column, raw: Column) -> Column:
    structural = F.when(raw > 0, clamp(F.try_divide(guaranteed, raw), 0.0, 1.0)).otherwise(0.0)
    return F.round(clamp(0.75 * clamp(similarity, 0.0, 1.0) + 0.25 * structural, 0.0, 1.0), 6)


def convergence_probability(base: Column, quality: Column) -> Column:
    return F.round(clamp(base * (0.55 + 0.45 * quality), 0.01, 0.99), 6)


def capture_amount(raw, guaranteed, probability, similarity, velocity, std, z, days) -> Column:
    """Part of the displayed spread that can realistically be captured."""
    ratio = (0.35 + 0.45 * probability + F.when(velocity < 0, 0.15).otherwise(0.0)
             + 0.10 * F.least(F.abs(z) / 2.5, F.lit(1.0))
             - 0.08 * F.least(std / F.greatest(F.abs(raw), F.lit(1e-6)), F.lit(2.0))
             - F.when(days > 180, 0.10).otherwise(0.0))
    ratio = clamp(ratio * (0.60 + 0.40 * clamp(similarity, 0.0, 1.0)), 0.05, 0.95)
    floor = F.when(guaranteed > 0, 0.90 * guaranteed).otherwise(0.0)
    estimate = F.least(F.greatest(raw * ratio, floor), raw)
    return F.when(raw > 0, F.round(estimate, 6)).otherwise(0.0)


def adverse_move(raw, similarity, velocity, std, days) -> Column:
    """Loss estimate when the spread does not converge."""
    risk = (0.50 * raw + F.when(velocity > 0, 0.75 * F.least(F.abs(velocity), raw)).otherwise(0.0)
            + F.when(days > 90, 0.15 * raw).otherwise(0.0)
            + F.when(std > F.abs(raw), 0.15 * raw).otherwise(0.0)
            + (1.0 - clamp(similarity, 0.0, 1.0)) * raw * 0.75)
    worst = F.greatest(1.0 - raw, 0.25 * raw)
    return F.when(raw > 0, F.round(F.least(risk, worst), 6)).otherwise(0.0)


def kelly_fraction(probability, spread, reward, risk, quality, bankroll: float = BANKROLL,
                   part: float = HALF_KELLY, cap: float = MAX_FRACTION) -> Column:
    """Unrounded capped Kelly share of the bankroll; 0 when nothing is left after the fee."""
    gain = F.greatest(F.coalesce(reward, spread), F.lit(0.0)) - FEE
    odds = gain / F.greatest(F.coalesce(risk, 0.5 * spread), F.lit(1e-6))
    p = clamp(probability * (0.50 + 0.50 * clamp(quality, 0.0, 1.0)), 0.0, 0.99)
    edge = F.greatest(F.try_divide(p * odds - (1.0 - p), odds), F.lit(0.0))
    usable = (spread > 0) & (probability > 0) & (F.lit(bankroll) > 0) & (gain > 0)
    return F.when(usable, F.least(edge * part, F.lit(cap))).otherwise(0.0)


def expected_value(probability, spread, position, reward, risk) -> Column:
    win = probability * F.greatest(F.greatest(reward, F.lit(0.0)) - FEE, F.lit(0.0)) * position
    loss = (1.0 - probability) * F.greatest(risk, F.lit(0.0)) * position
    return F.when((position > 0) & (spread > 0), F.round(win - loss, 4)).otherwise(0.0)


def signal_confidence(probability, raw, guaranteed, similarity, points) -> Column:
    spread_part = F.when(guaranteed > 0, F.least(guaranteed / 0.10, F.lit(1.0))).otherwise(
        F.least(raw / 0.12, F.lit(0.7)))
    data_part = F.least(points / F.lit(100.0), F.lit(1.0))
    return F.round(clamp(0.35 * probability + 0.25 * spread_part + 0.25 * similarity
                         + 0.15 * data_part, 0.0, 1.0), 4)


# ---------------------------------------------------------------- live checks

def liquidity_issues(liq_a, liq_b, size, share: float = LIQUIDITY_SHARE) -> Column:
    thin = F.least(liq_a, liq_b)
    return F.filter(F.array(
        F.when(liq_a <= 0, F.lit("Platform A has zero liquidity")),
        F.when(liq_b <= 0, F.lit("Platform B has zero liquidity")),
        F.when((thin > 0) & (size > thin * share), F.concat(
            F.lit("Position $"), F.format_string("%.0f", size),
            F.lit(f" exceeds {share * 100:.0f}% of min liquidity $"),
            F.format_string("%.0f", thin)))), lambda r: r.isNotNull())


def liquidity_size(size, liq_a, liq_b, share: float = LIQUIDITY_SHARE) -> Column:
    usable = (liq_a > 0) & (liq_b > 0)
    return F.when(usable, F.round(F.least(size, F.least(liq_a, liq_b) * share), 2)).otherwise(0.0)


def resolution(last_price: Column) -> Column:
    """YES from 0.8 up, NO from 0.2 down, else unknown."""
    return F.when(last_price >= 0.8, "YES").when(last_price <= 0.2, "NO")


def resolved_pnl(res_a, res_b, side, price_a, price_b, raw, size) -> Column:
    """Realised profit of one pair; null while either side is unresolved."""
    yes = lambda res, price: F.when(res == "YES", 1.0 - price).otherwise(-price)
    no = lambda res, price: F.when(res == "NO", price).otherwise(price - 1.0)
    legs = F.when(side == BUY_B, yes(res_b, price_b) + no(res_a, price_a)).otherwise(
        yes(res_a, price_a) + no(res_b, price_b))
    return F.when(res_a.isNotNull() & res_b.isNotNull(),
                  F.round(F.when(res_a == res_b, raw * size).otherwise(legs * size), 2))
