"""Option chains: ``underlying, expiry, strike, spot, CE_iv, PE_iv`` (percent), ``CE_price, PE_price, oi, volume``.

Everything is per chain (underlying and expiry), so the history of chains is what grows, not a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.expr import band_score, divide, normal_cdf, normal_pdf

C = F.col
CHAIN = ("underlying", "expiry")
#: Margin of a sold lot, by underlying; any other as NIFTY.
SELL_MARGIN = {"NIFTY": 195000.0, "NIFTY50": 195000.0, "BANKNIFTY": 130000.0, "FINNIFTY": 60000.0, "MIDCPNIFTY": 75000.0}


def moneyness(df: DataFrame, step: float = 50.0) -> DataFrame:
    """ITM, OTM or ATM for calls and puts; ATM is the spot rounded to ``step``, halves to even."""
    atm = F.bround(C("spot") / step) * step
    side = lambda inside: F.when(C("strike") == C("atm"), "ATM").when(inside, "ITM").otherwise("OTM")
    df = df.withColumn("atm", atm)
    return df.withColumns({"CE_moneyness": side(C("strike") < C("spot")), "PE_moneyness": side(C("strike") > C("spot"))})


def side_by_side(df: DataFrame) -> DataFrame:
    """Calls, strike, puts in that order; other columns follow."""
    first = [c for c in df.columns if c.startswith("CE_")] + ["strike"] + [c for c in df.columns if c.startswith("PE_")]
    return df.select(*first, *(c for c in df.columns if c not in first))


def next_expiries(df: DataFrame, as_of: str, n: int = 7) -> DataFrame:
    """Rows of the ``n`` nearest expiries of each underlying on or after a date."""
    left = df.filter(C("expiry") >= F.lit(as_of).cast("date"))
    return left.withColumn("nth", F.dense_rank().over(Window.partitionBy("underlying").orderBy("expiry"))).filter(C("nth") <= n).drop("nth")


def fix_iv(iv: Column) -> Column:
    """Volatility as a share: percents are divided by 100, and once more if still 3 or above."""
    share = iv / 100
    return F.when(share >= 3, share / 100).otherwise(share)


def greeks(df: DataFrame, as_of: str, r: float = 0.065, q: float = 0.0, plain_theta: bool = True) -> DataFrame:
    """Delta, gamma, vega (per 1 %), theta per day and rho of calls and puts; null for bad inputs. ``plain_theta`` leaves the
    interest term of theta out."""
    days = F.datediff("expiry", F.lit(as_of).cast("date"))
    df = df.withColumns({"days": days, "T": days / 365.0})
    s, k, t = C("spot"), C("strike"), C("T")
    grow, paid = F.exp(-q * t), F.exp(-r * t)
    for side, name in (("CE", "Call"), ("PE", "Put")):
        v = fix_iv(C(f"{side}_iv"))
        ok = (v > 0) & (t > 0) & (s > 0) & (k > 0)
        root = v * F.sqrt(t)
        df = df.withColumn("d1", F.when(ok, (F.log(s / k) + (r - q + v * v / 2) * t) / root)).withColumn("d2", C("d1") - root)
        d1, d2 = C("d1"), C("d2")
        decay = -(s * v * grow * normal_pdf(d1)) / (2 * F.sqrt(t))
        sign = 1 if side == "CE" else -1
        interest = F.lit(0.0) if plain_theta else sign * r * k * paid * normal_cdf(sign * d2)
        df = df.withColumns({
            f"{name}_Delta": grow * (normal_cdf(d1) if side == "CE" else normal_cdf(d1) - 1),
            f"{name}_Gamma": F.when(ok, grow * normal_pdf(d1) / (s * root)),
            f"{name}_Vega": F.when(ok, s * grow * normal_pdf(d1) * F.sqrt(t) / 100),
            f"{name}_Theta": F.when(ok, (decay - interest + sign * q * s * grow * normal_cdf(sign * d1)) / 365),
            f"{name}_Rho": sign * k * t * paid * normal_cdf(sign * d2),
        }).drop("d1", "d2")
    return df.drop("T")


def iv_rv_spread(df: DataFrame, realized: DataFrame) -> DataFrame:
    """Implied less latest realised volatility, in percent. ``realized (underlying, realized_vol)`` has a row per underlying."""
    joined = df.join(realized, "underlying")
    rv = 100 * C("realized_vol")
    return joined.withColumns({"CE_spread": C("CE_iv") - rv, "PE_spread": C("PE_iv") - rv})


def rank_strikes(df: DataFrame, below: float = 0.05, above: float = 0.05) -> DataFrame:
    """Strikes near the spot ranked by the larger spread of the two sides, with what to do about it."""
    near = df.filter(C("strike").between(C("spot") * (1 - below), C("spot") * (1 + above)))
    call, put = F.abs("CE_spread"), F.abs("PE_spread")
    act = F.when(call > put, F.when(C("CE_spread") > 0, "Sell Call").otherwise("Buy Call")).otherwise(F.when(C("PE_spread") > 0, "Sell Put").otherwise("Buy Put"))
    near = near.withColumns({"imbalance": F.greatest(call, put), "signal": act})
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("underlying").orderBy(F.desc("imbalance"), "expiry", "strike")))


def _nearness(target: Column) -> Column:
    """What orders strikes by their distance from ``target``, ties to the lower strike. Distances that differ by rounding only are ties."""
    return F.struct(F.round(F.abs(C("strike") - target), 6), "strike")


def nearest_strike(df: DataFrame, targets: DataFrame) -> DataFrame:
    """For ``targets`` (chain, ``target``, further columns): the strike and prices nearest to each, ties to the lower strike."""
    keys = targets.columns
    strikes = df.select(*CHAIN, "strike", "CE_price", "PE_price")
    near = targets.join(strikes, list(CHAIN)).groupBy(*keys).agg(F.min_by(F.struct("strike", "CE_price", "PE_price"), _nearness(C("target"))).alias("near"))
    return near.select(*keys, "near.*")


def ltp_probability(df: DataFrame, step: float = 50.0) -> DataFrame:
    """For distances 0, ``step``, ... from the spot: prices of the nearest call above and put below, and their shares in percent."""
    chains = df.groupBy(*CHAIN).agg(F.first("spot").alias("spot"), (F.max("strike") - F.min("strike")).alias("range"))
    far = F.sequence(F.lit(0), F.ceil((C("range") + step) / step).cast("int") - 1)
    grid = chains.select(*CHAIN, "spot", F.explode(far).alias("k")).select(*CHAIN, "spot", (C("k") * step).alias("distance"))
    calls = nearest_strike(df, grid.withColumn("target", C("spot") + C("distance"))).select(*CHAIN, "distance", C("strike").alias("call_strike"), C("CE_price").alias("call"))
    puts = nearest_strike(df, grid.withColumn("target", C("spot") - C("distance"))).select(*CHAIN, "distance", C("strike").alias("put_strike"), C("PE_price").alias("put"))
    both = calls.join(puts, [*CHAIN, "distance"])
    return both.withColumns({"prob_above": 100 * divide(C("call"), C("call") + C("put")), "prob_below": 100 * divide(C("put"), C("call") + C("put"))})


def score_legs(df: DataFrame, top: int = 5) -> DataFrame:
    """The best legs of each chain, side and position by delta, decay, gamma, time, liquidity and, if sold, return. Needs ``greeks``.

    Decay is what a day costs. For a bought call it is taken with the sign that theta itself has, as in the rule's origin.
    """
    sides = F.explode(F.array(*(
        F.struct(F.lit(t).alias("type"), F.lit(p).alias("position"), C(f"{side}_price").alias("price"), F.abs(f"{name}_Delta").alias("delta"), ((1 if (t, p) == ("C", "long") else -1) * C(f"{name}_Theta")).alias("decay"), F.abs(f"{name}_Gamma").alias("gamma"))
        for t, side, name in (("C", "CE", "Call"), ("P", "PE", "Put")) for p in ("short", "long")
    )))
    legs = df.select(*CHAIN, "strike", "spot", "days", "oi", "volume", sides.alias("leg")).select(*CHAIN, "strike", "spot", "days", "oi", "volume", "leg.*")
    legs = legs.filter("price IS NOT NULL AND delta <> 0")
    sold = C("position") == "short"
    margin = F.when(C("type") == "P", C("strike")).otherwise(3 * C("spot"))
    delta = F.when(sold, band_score(C("delta"), 0.1, 0.3)).otherwise(band_score(C("delta"), 0.5, 0.7))
    decay = F.when(sold, 1.5 * F.tanh(F.greatest(C("decay"), F.lit(0.0)) / 100)).otherwise(-F.tanh(C("decay") / 100))
    time = F.when(C("days").between(F.lit(7), F.when(sold, 30).otherwise(45)), 1.0).otherwise(0.5)
    gain = F.when(sold, 3 * F.least(divide(100 * C("price"), margin), F.lit(1.0))).otherwise(0.0)
    legs = legs.withColumn("score", 2 * delta + decay - F.tanh(C("gamma") / 0.02) + time + 0.5 * F.log1p(C("oi") + C("volume")) + gain)
    best = Window.partitionBy(*CHAIN, "type", "position").orderBy(F.desc("score"), "strike")
    return legs.withColumn("rank", F.row_number().over(best)).filter(C("rank") <= top)


def iron_condor(df: DataFrame, wings: float = 1.5, days: int = 7, unit: float = 100.0) -> DataFrame:
    """A weekly iron condor per chain: shorts at the expected move around the ATM strike, wings ``wings`` moves further, all on strikes."""
    spots = df.groupBy(*CHAIN).agg(F.first("spot").alias("spot"))
    ivs = df.select(*CHAIN, "strike", C("PE_iv").alias("iv"))
    atm = spots.join(ivs, list(CHAIN)).groupBy(*CHAIN, "spot").agg(F.min_by(F.struct("strike", "iv"), _nearness(C("spot"))).alias("atm"))
    move = F.bround(C("spot") * C("atm.iv") / 100 * (days / 252) ** 0.5 / unit) * unit
    atm = atm.withColumn("move", move)
    ends = {"short_put": -1.0, "long_put": -1.0 - wings, "short_call": 1.0, "long_call": 1.0 + wings}
    targets = atm.select(*CHAIN, F.explode(F.array(*(F.struct(F.lit(n).alias("leg"), (C("atm.strike") + C("move") * x).alias("target")) for n, x in ends.items()))).alias("t")).select(*CHAIN, "t.leg", "t.target")
    legs = nearest_strike(df, targets).withColumn("price", F.when(C("leg").contains("put"), C("PE_price")).otherwise(C("CE_price")))
    wide = legs.groupBy(*CHAIN).agg(*(F.max(F.when(C("leg") == n, C(x))).alias(f"{n}{y}") for n in ends for x, y in (("strike", ""), ("price", "_price"))))
    width = F.greatest(C("short_put") - C("long_put"), C("long_call") - C("short_call"))
    wide = wide.withColumns({"credit": C("short_put_price") + C("short_call_price"), "max_loss": width})
    wide = wide.withColumn("roi", F.coalesce(divide(C("credit"), C("max_loss")), F.lit(0.0)))
    return wide.withColumn("rank", F.row_number().over(Window.partitionBy("underlying").orderBy(F.desc("roi"), "expiry")))


def price_legs(legs: DataFrame, chain: DataFrame) -> DataFrame:
    """``premium`` of legs (``underlying, expiry, strike, type C or P``): the chain's price, where it isn't 0."""
    prices = chain.select(*CHAIN, "strike", F.explode(F.array(F.struct(F.lit("C").alias("type"), C("CE_price").alias("premium")), F.struct(F.lit("P").alias("type"), C("PE_price").alias("premium")))).alias("p"))
    prices = prices.select(*CHAIN, "strike", "p.*").filter("premium <> 0").groupBy(*CHAIN, "strike", "type").agg(F.first("premium").alias("premium"))
    return legs.join(prices, [*CHAIN, "strike", "type"], "left")


def payoff(legs: DataFrame, prices: DataFrame, lot: int = 50) -> DataFrame:
    """Payoff at expiry of each ``strategy_id`` over ``prices (strategy_id, price)``, times the lot."""
    intrinsic = F.greatest(F.when(C("type") == "C", C("price") - C("strike")).otherwise(C("strike") - C("price")), F.lit(0.0))
    sign = F.when(C("action") == "SELL", -1.0).otherwise(1.0)
    return legs.join(prices, "strategy_id").groupBy("strategy_id", "price").agg((lot * F.sum(sign * (intrinsic - F.abs("premium")))).alias("payoff"))


def price_grid(spots: DataFrame, buffer: float = 0.1, step: float = 50.0) -> DataFrame:
    """``strategy_id, price``: from ``buffer`` below to ``buffer`` above the spot in steps."""
    low, high = F.floor(C("spot") * (1 - buffer) / step), F.ceil(C("spot") * (1 + buffer) / step)
    return spots.select("strategy_id", F.explode(F.sequence(low, high)).alias("k")).select("strategy_id", (C("k") * step).alias("price"))


def margin(legs: DataFrame, lot: int = 50, hedge: float = 0.6) -> DataFrame:
    """Margin of each strategy: premiums of bought lots and a fixed sum per sold one, less for hedged strategies."""
    per = F.lit(SELL_MARGIN["NIFTY"])
    for name, value in SELL_MARGIN.items():
        per = F.when(F.upper("underlying") == name, F.lit(value)).otherwise(per)
    own = F.when(C("action") == "BUY", F.abs("premium") * lot).otherwise(per)
    both = F.bool_or(C("action") == "BUY") & F.bool_or(C("action") == "SELL")
    return legs.groupBy("strategy_id").agg((F.sum(own) * F.when(both, hedge).otherwise(1.0)).alias("margin"))


def choose_strategies(snapshot: DataFrame, library: DataFrame) -> DataFrame:
    """Strategies of ``library (trend, volatility, name, description)``, a small table, for a market snapshot."""
    return snapshot.join(library, ["trend", "volatility"])


def flatten_chain(raw: DataFrame) -> DataFrame:
    """Rows of nested ``records.data[]`` with ``CE`` and ``PE`` objects, as ``CE_*`` and ``PE_*`` columns."""
    rows = raw.select(F.explode("records.data").alias("d"))
    parts = {f.name: f.dataType for f in rows.schema["d"].dataType.fields}
    nested = [C(f"d.{side}.{x.name}").alias(f"{side}_{x.name}") for side in ("CE", "PE") if side in parts for x in parts[side].fields]
    return rows.select(*(C(f"d.{name}") for name in parts if name not in ("CE", "PE")), *nested)
