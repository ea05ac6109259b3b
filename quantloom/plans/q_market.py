"""Queries over option chains, news, models, files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import models as M
from quantloom.operators import news as N
from quantloom.operators import options as O
from quantloom.operators import windows as W
from quantloom.operators.evaluate import split_by_ticker
from quantloom.operators.sentiment import bounded_sample, fit_sentiment, score_learned
from quantloom.operators.regime import append_forecast, forecast, regime_5
from quantloom.plans.inputs import BARS, CHAIN, NEWS, bars, chain, news, news_items, table
from quantloom.plans.q_bars import KEY, over
from quantloom.plans.q_research import _suite_sql, suite
from quantloom.plans.registry import query
from quantloom.sources import files, store
from quantloom.sources.vendor import register
from quantloom.streaming import streams
from quantloom.streaming.indicators import stream_indicators

C = F.col
AS_OF = "2024-01-10"


@query(f"WITH {CHAIN} SELECT underlying, expiry, strike, round_even(spot / 50, 0) * 50 AS atm, CASE WHEN strike = round_even(spot / 50, 0) * 50 THEN 'ATM' WHEN strike < spot THEN 'ITM' ELSE 'OTM' END AS CE_moneyness, CASE WHEN strike = round_even(spot / 50, 0) * 50 THEN 'ATM' WHEN strike > spot THEN 'ITM' ELSE 'OTM' END AS PE_moneyness FROM chain")
def p13_moneyness(spark, sf_dir):
    return O.moneyness(chain(spark, sf_dir)).select("underlying", "expiry", "strike", "atm", "CE_moneyness", "PE_moneyness")


@query(f"WITH {CHAIN} SELECT * FROM chain", "spot CE_price PE_price")
def p14_side_by_side(spark, sf_dir):
    return O.side_by_side(chain(spark, sf_dir))


@query(f"WITH {CHAIN} SELECT underlying, expiry, strike FROM chain WHERE expiry >= DATE '2024-02-01' QUALIFY dense_rank() OVER (PARTITION BY underlying ORDER BY expiry) <= 1")
def t4_next_expiries(spark, sf_dir):
    return O.next_expiries(chain(spark, sf_dir), "2024-02-01", 1).select("underlying", "expiry", "strike")


def _cdf(x: str) -> str:
    t = f"(1 / (1 + 0.2316419 * abs({x})))"
    tail = f"(exp(-({x}) * ({x}) / 2) * 0.3989422804014327 * {t} * (0.319381530 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429)))))"
    return f"(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


_PDF = "(exp(-d1 * d1 / 2) * 0.3989422804014327)"
_GREEKS = f"""{CHAIN}, g0 AS (SELECT *, datediff('day', DATE '{AS_OF}', expiry) AS days, datediff('day', DATE '{AS_OF}', expiry) / 365.0::DOUBLE AS T, CE_iv / 100 AS v, PE_iv / 100 AS u FROM chain),
    gc AS (SELECT *, CASE WHEN v > 0 THEN (ln(spot / strike) + (0.065 + v * v / 2) * T) / (v * sqrt(T)) END AS d1 FROM g0), gp AS (SELECT *, CASE WHEN u > 0 THEN (ln(spot / strike) + (0.065 + u * u / 2) * T) / (u * sqrt(T)) END AS d1 FROM g0)"""


@query(f"""WITH {_GREEKS} SELECT gc.underlying, gc.expiry, gc.strike, {_cdf('gc.d1')} AS Call_Delta, exp(-gc.d1 * gc.d1 / 2) * 0.3989422804014327 / (gc.spot * v * sqrt(gc.T)) AS Call_Gamma, gc.spot * exp(-gc.d1 * gc.d1 / 2) * 0.3989422804014327 * sqrt(gc.T) / 100 AS Call_Vega,
    -(gc.spot * gc.v * exp(-gc.d1 * gc.d1 / 2) * 0.3989422804014327) / (2 * sqrt(gc.T)) / 365 AS Call_Theta, gc.strike * gc.T * exp(-0.065 * gc.T) * {_cdf('(gc.d1 - gc.v * sqrt(gc.T))')} AS Call_Rho,
    {_cdf('gp.d1')} - 1 AS Put_Delta, exp(-gp.d1 * gp.d1 / 2) * 0.3989422804014327 / (gp.spot * gp.u * sqrt(gp.T)) AS Put_Gamma, gp.spot * exp(-gp.d1 * gp.d1 / 2) * 0.3989422804014327 * sqrt(gp.T) / 100 AS Put_Vega,
    -(gp.spot * gp.u * exp(-gp.d1 * gp.d1 / 2) * 0.3989422804014327) / (2 * sqrt(gp.T)) / 365 AS Put_Theta, -gc.strike * gc.T * exp(-0.065 * gc.T) * {_cdf('(-(gp.d1 - gp.u * sqrt(gp.T)))')} AS Put_Rho
    FROM gc JOIN gp ON gc.underlying = gp.underlying AND gc.expiry = gp.expiry AND gc.strike = gp.strike""".replace("spot * v *", "spot * gc.v *"), "Call_Delta Call_Gamma Call_Vega Call_Theta Call_Rho Put_Delta Put_Gamma Put_Vega Put_Theta Put_Rho")
def o1_o2_greeks(spark, sf_dir):
    return O.greeks(chain(spark, sf_dir), AS_OF).select("underlying", "expiry", "strike", "Call_Delta", "Call_Gamma", "Call_Vega", "Call_Theta", "Call_Rho", "Put_Delta", "Put_Gamma", "Put_Vega", "Put_Theta", "Put_Rho")


def _spread(spark, sf_dir):
    c = chain(spark, sf_dir)
    return O.iv_rv_spread(c, c.groupBy("underlying").agg((F.avg("CE_iv") / 100).alias("realized_vol")))


_SPREAD = f"{CHAIN}, sp AS (SELECT chain.*, CE_iv - 100 * rv AS CE_spread, PE_iv - 100 * rv AS PE_spread FROM chain JOIN (SELECT underlying, avg(CE_iv) / 100 AS rv FROM chain GROUP BY underlying) r ON chain.underlying = r.underlying)"


@query(f"WITH {_SPREAD} SELECT underlying, expiry, strike, CE_spread, PE_spread FROM sp", "CE_spread PE_spread")
def o3_j11_iv_rv_spread(spark, sf_dir):
    return _spread(spark, sf_dir).select("underlying", "expiry", "strike", "CE_spread", "PE_spread")


@query(f"""WITH {_SPREAD} SELECT underlying, expiry, strike, greatest(abs(CE_spread), abs(PE_spread)) AS imbalance, CASE WHEN abs(CE_spread) > abs(PE_spread) THEN CASE WHEN CE_spread > 0 THEN 'Sell Call' ELSE 'Buy Call' END WHEN PE_spread > 0 THEN 'Sell Put' ELSE 'Buy Put' END AS signal
    FROM sp WHERE strike BETWEEN spot * 0.95 AND spot * 1.05""", "imbalance")
def t3_rank_strikes(spark, sf_dir):
    return O.rank_strikes(_spread(spark, sf_dir)).select("underlying", "expiry", "strike", "imbalance", "signal")


@query(f"""WITH {CHAIN}, ch AS (SELECT underlying, expiry, any_value(spot) AS spot, max(strike) - min(strike) AS r FROM chain GROUP BY ALL), gr AS (SELECT underlying, expiry, spot, unnest(range(0, ceil((r + 50) / 50)::INT)) * 50.0::DOUBLE AS distance FROM ch),
    ca AS (SELECT gr.underlying, gr.expiry, distance, arg_min(strike, abs(strike - (gr.spot + distance)) * 1e6 + strike) AS call_strike, arg_min(CE_price, abs(strike - (gr.spot + distance)) * 1e6 + strike) AS call, arg_min(strike, abs(strike - (gr.spot - distance)) * 1e6 + strike) AS put_strike, arg_min(PE_price, abs(strike - (gr.spot - distance)) * 1e6 + strike) AS put
           FROM gr JOIN chain ON gr.underlying = chain.underlying AND gr.expiry = chain.expiry GROUP BY ALL)
    SELECT *, 100 * call / nullif(call + put, 0) AS prob_above, 100 * put / nullif(call + put, 0) AS prob_below FROM ca""", "call put prob_above prob_below")
def o4_j6_ltp_probability(spark, sf_dir):
    return O.ltp_probability(chain(spark, sf_dir))


_BAND = "CASE WHEN delta BETWEEN {0} AND {1} THEN 1.0 ELSE greatest(0.0, 1 - least(abs(delta - {0}), abs(delta - {1})) / 0.02) END"
_OPTION_LEGS = " UNION ALL ".join(
    f"SELECT underlying, expiry, strike, spot, days, oi, volume, '{kind}' AS type, {side}_price AS price, abs({_cdf('d1')}{less}) AS delta, spot * {v} * {_PDF} / (2 * sqrt(T)) / 365 AS decay, {_PDF} / (spot * {v} * sqrt(T)) AS gamma FROM {source} WHERE d1 IS NOT NULL"
    for kind, side, less, v, source in (("C", "CE", "", "v", "gc"), ("P", "PE", " - 1", "u", "gp"))
)


@query(f"""WITH {_GREEKS}, ol AS ({_OPTION_LEGS}), op AS (SELECT ol.*, unnest(['short', 'long']) AS position FROM ol WHERE delta <> 0),
    os AS (SELECT *, CASE WHEN position = 'short' THEN 2 * ({_BAND.format(0.1, 0.3)}) + 1.5 * tanh(greatest(decay, 0.0) / 100) + CASE WHEN days BETWEEN 7 AND 30 THEN 1.0 ELSE 0.5 END + 3 * least(100 * price / CASE type WHEN 'P' THEN strike ELSE 3 * spot END, 1.0)
        ELSE 2 * ({_BAND.format(0.5, 0.7)}) - tanh(CASE type WHEN 'C' THEN -decay ELSE decay END / 100) + CASE WHEN days BETWEEN 7 AND 45 THEN 1.0 ELSE 0.5 END END - tanh(gamma / 0.02) + 0.5 * ln(1 + oi + volume) AS score FROM op)
    SELECT underlying, expiry, type, position, strike, score, CAST(row_number() OVER (PARTITION BY underlying, expiry, type, position ORDER BY score DESC, strike) AS INT) AS rank FROM os QUALIFY rank <= 5""", "score", 5)
def o5_t2_score_legs(spark, sf_dir):
    return O.score_legs(O.greeks(chain(spark, sf_dir), AS_OF)).select("underlying", "expiry", "type", "position", "strike", "score", "rank")


_NEAR = "arg_min({0}, abs(strike - ({1})) * 1e6 + strike)"
_ENDS = {"short_put": "atm - move", "long_put": "atm - 2.5 * move", "short_call": "atm + move", "long_call": "atm + 2.5 * move"}


@query(f"""WITH {CHAIN}, ia AS (SELECT underlying, expiry, any_value(spot) AS spot, arg_min(strike, abs(strike - spot) * 1e6 + strike) AS atm, arg_min(PE_iv, abs(strike - spot) * 1e6 + strike) AS iv FROM chain GROUP BY ALL),
    im AS (SELECT *, round_even(spot * iv / 100 * sqrt(7 / 252.0::DOUBLE) / 100, 0) * 100 AS move FROM ia),
    il AS (SELECT im.underlying, im.expiry, im.spot, atm, iv, move, {', '.join(f"{_NEAR.format('strike', x)} AS {n}, {_NEAR.format('PE_price' if 'put' in n else 'CE_price', x)} AS {n}_price" for n, x in _ENDS.items())} FROM im JOIN chain ON im.underlying = chain.underlying AND im.expiry = chain.expiry GROUP BY ALL),
    ic AS (SELECT underlying, expiry, {', '.join(f'{n}, {n}_price' for n in _ENDS)}, short_put_price + short_call_price AS credit, greatest(short_put - long_put, long_call - short_call) AS max_loss FROM il)
    SELECT *, coalesce(credit / nullif(max_loss, 0), 0) AS roi, CAST(row_number() OVER (PARTITION BY underlying ORDER BY coalesce(credit / nullif(max_loss, 0), 0) DESC, expiry) AS INT) AS rank FROM ic""", "credit max_loss roi short_put_price long_put_price short_call_price long_call_price")
def o6_iron_condor(spark, sf_dir):
    return O.iron_condor(chain(spark, sf_dir))


def _legs(spark, sf_dir):
    """A strangle sold per chain, hedged by a call above."""
    c = chain(spark, sf_dir)
    ends = c.groupBy("underlying", "expiry").agg(F.min("strike").alias("low"), F.max("strike").alias("high"))
    legs = F.explode(F.array(*(F.struct(F.lit(t).alias("type"), F.lit(a).alias("action"), C(k).alias("strike")) for t, a, k in (("P", "SELL", "low"), ("C", "SELL", "low"), ("C", "BUY", "high")))))
    return O.price_legs(ends.select("underlying", "expiry", F.concat_ws("|", "underlying", "expiry").alias("strategy_id"), legs.alias("l")).select("underlying", "expiry", "strategy_id", "l.*"), c)


_LEGS = f"""{CHAIN}, en AS (SELECT underlying, expiry, min(strike) AS low, max(strike) AS high FROM chain GROUP BY ALL), lg AS (SELECT underlying, expiry, underlying || '|' || expiry AS strategy_id, unnest(['P', 'C', 'C']) AS type, unnest(['SELL', 'SELL', 'BUY']) AS action, unnest([low, low, high]) AS strike FROM en),
    pl AS (SELECT lg.*, CASE WHEN type = 'C' THEN nullif(CE_price, 0) ELSE nullif(PE_price, 0) END AS premium FROM lg LEFT JOIN chain c ON lg.underlying = c.underlying AND lg.expiry = c.expiry AND lg.strike = c.strike)"""


@query(f"WITH {_LEGS} SELECT strategy_id, type, action, strike, premium FROM pl", "premium")
def o9_price_legs(spark, sf_dir):
    return _legs(spark, sf_dir).select("strategy_id", "type", "action", "strike", "premium")


@query(f"""WITH {_LEGS}, pr AS (SELECT DISTINCT underlying || '|' || expiry AS strategy_id, spot FROM chain), gr AS (SELECT strategy_id, unnest(range(floor(spot * 0.9 / 50)::INT, ceil(spot * 1.1 / 50)::INT + 1)) * 50.0::DOUBLE AS price FROM pr)
    SELECT pl.strategy_id, price, 50 * sum(CASE WHEN action = 'SELL' THEN -1.0 ELSE 1.0 END * (greatest(CASE WHEN type = 'C' THEN price - strike ELSE strike - price END, 0.0) - abs(premium))) AS payoff FROM pl JOIN gr ON pl.strategy_id = gr.strategy_id GROUP BY ALL""", "payoff", 4)
def o7_payoff(spark, sf_dir):
    spots = chain(spark, sf_dir).select(F.concat_ws("|", "underlying", "expiry").alias("strategy_id"), "spot").distinct()
    return O.payoff(_legs(spark, sf_dir), O.price_grid(spots))


@query(f"WITH {_LEGS} SELECT strategy_id, 0.6 * sum(CASE WHEN action = 'BUY' THEN abs(premium) * 50 ELSE 195000.0 END) AS margin FROM pl GROUP BY strategy_id", "margin", 4)
def o8_margin(spark, sf_dir):
    return O.margin(_legs(spark, sf_dir))


@query(f"WITH {BARS} SELECT Ticker, trend, volatility, name FROM (SELECT Ticker, CASE WHEN max_by(Close, Date) > avg(Close) THEN 'bullish' ELSE 'bearish' END AS trend, CASE WHEN max_by(Volume, Date) > 25 THEN 'high' ELSE 'low' END AS volatility FROM bars GROUP BY Ticker) JOIN (VALUES ('bullish', 'low', 'Short Put'), ('bullish', 'low', 'Covered Call'), ('bullish', 'high', 'Long Call'), ('bearish', 'low', 'Short Call'), ('bearish', 'high', 'Long Put')) l(t, v, name) ON trend = t AND volatility = v")
def o10_j10_choose_strategies(spark, sf_dir):
    b = bars(spark, sf_dir).groupBy("Ticker").agg(F.when(F.max_by("Close", "Date") > F.avg("Close"), "bullish").otherwise("bearish").alias("trend"), F.when(F.max_by("Volume", "Date") > 25, "high").otherwise("low").alias("volatility"))
    rows = [("bullish", "low", "Short Put"), ("bullish", "low", "Covered Call"), ("bullish", "high", "Long Call"), ("bearish", "low", "Short Call"), ("bearish", "high", "Long Put")]
    return O.choose_strategies(b, spark.createDataFrame(rows, "trend string, volatility string, name string")).select("Ticker", "trend", "volatility", "name")


@query(f"WITH {CHAIN} SELECT underlying, CAST(expiry AS VARCHAR) AS expiry, CE_strike, CE_iv, PE_strike, PE_iv FROM (SELECT underlying, expiry, strike AS CE_strike, CE_iv, strike AS PE_strike, PE_iv FROM chain)")
def io7_x12_flatten_chain(spark, sf_dir):
    side = lambda s: F.struct(C("strike"), C(f"{s}_iv").alias("iv")).alias(s)
    # a document holds an expiry's strikes in one of 16 parts, so no underlying is one row
    part = F.pmod(F.xxhash64("strike"), F.lit(16))
    nested = chain(spark, sf_dir).groupBy("underlying", C("expiry").alias("of"), part).agg(F.collect_list(F.struct("underlying", C("expiry").cast("string").alias("expiry"), side("CE"), side("PE"))).alias("data"))
    raw = nested.select(F.struct("data").alias("records"))
    text = raw.select(F.to_json(F.struct("records")).alias("j"))
    return O.flatten_chain(text.select(F.from_json("j", raw.schema).alias("r")).select("r.*"))


def _prepared(spark, sf_dir):
    return N.prepared(news(spark, sf_dir))


_CATEGORY = " ".join("WHEN " + " OR ".join(f"contains(title, '{w}')" for w in words) + f" THEN '{name}'" for name, words in N.CATEGORIES.items())
_ASCII = f"{NEWS}, ni AS (SELECT stock, link, published, lower(regexp_replace(title, '[^a-zA-Z ]', '', 'g')) AS title FROM news WHERE title IS NOT NULL AND stock IS NOT NULL)"


@query(f"WITH {_ASCII} SELECT stock, link, CASE {_CATEGORY} ELSE 'general' END AS category FROM ni")
def x5_n7_categories(spark, sf_dir):
    plain = news(spark, sf_dir).dropna(subset=["title", "stock"]).withColumn("title", F.lower(F.regexp_replace("title", "[^a-zA-Z ]", "")))
    return plain.select("stock", "link", N.categorize(C("title")).alias("category"))


_SPACES = r"\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LETTERS = r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}"
#: The default lexicon, and the abuse that the given texts hold.
PROSE = N.LEXICON | {w: -1 for w in ("clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")}
_SIGNED = lambda sign: "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{k}'" for k, v in PROSE.items() if v == sign) + ")))"
_CLEAN = f"""{NEWS}, nc AS (SELECT stock, link, published, trim(lower(regexp_replace(regexp_replace(regexp_replace(title, '[^{_LETTERS}{_SPACES}]', '', 'g'), '\\p{{Nd}}{{1,2}}[{_SPACES}][{_LETTERS}]+[{_SPACES}]\\p{{Nd}}{{4}}', '', 'g'), '[â€™”“œ\\x{{9d}}¦]', chr(39), 'g'))) AS title
        FROM news WHERE title IS NOT NULL AND stock IS NOT NULL),
    nw AS (SELECT stock, link, published, title AS clean_title, CASE {_CATEGORY} ELSE 'general' END AS category, string_split_regex(title, '[ \\t\\n\\x0b\\f\\r]+') AS w FROM nc),
    sn AS (SELECT stock, link, published, clean_title, category, CASE category {' '.join(f"WHEN '{k}' THEN {v}" for k, v in N.WEIGHTS.items())} END::DOUBLE AS weight, round(coalesce(100.0 * ({_SIGNED(1)} - {_SIGNED(-1)}) / nullif({_SIGNED(1)} + {_SIGNED(-1)}, 0), 0), 2) AS score FROM nw)"""


@query(f"WITH {_CLEAN} SELECT link, clean_title FROM sn")
def x4_clean_text(spark, sf_dir):
    return _prepared(spark, sf_dir).select("link", "clean_title")


@query(f"WITH {_CLEAN} SELECT link, category, weight FROM sn", "weight")
def x7_weights(spark, sf_dir):
    return _prepared(spark, sf_dir).select("link", "category", "weight")


@query(f"WITH {NEWS} SELECT link, lower(regexp_extract(title, '(?i)(the|with|eine|pour)', 1)) AS keyword FROM news WHERE regexp_matches(title, '(?i)(the|with|eine|pour)')")
def x6_keyword_filter(spark, sf_dir):
    return N.keyword_filter(news(spark, sf_dir), ["the", "with", "eine", "pour"]).select("link", "keyword")


@query(f"WITH {NEWS} SELECT link, published FROM news WHERE published >= TIMESTAMP '2024-01-03 09:45:00' AND published <= TIMESTAMP '2024-01-05 03:54:00'")
def n1_publication_window(spark, sf_dir):
    # an item stands on the end
    return N.published_between(news(spark, sf_dir), "2024-01-03 09:45:00", "2024-01-05 03:54:00").select("link", "published")


@query(f"WITH {NEWS} SELECT link, CAST(published - INTERVAL 225 MINUTE AS DATE) AS day, strftime(published + INTERVAL 330 MINUTE, '%Y-%m-%d %H:%M') AS published_ist FROM news")
def n2_x2_trading_day(spark, sf_dir):
    return N.with_trading_day(news(spark, sf_dir)).select("link", "day", "published_ist")


def _scored_news(spark, sf_dir):
    return N.score_sentiment(_prepared(spark, sf_dir), lexicon=PROSE)


@query(f"WITH {_CLEAN} SELECT stock, round(avg(score), 2) AS mean_score, round(avg(score * weight), 2) AS mean_weighted, round(avg(weight), 2) AS mean_weight, count(*) AS items FROM sn GROUP BY stock")
def n4_sentiment_by_stock(spark, sf_dir):
    return N.sentiment_by(_scored_news(spark, sf_dir), ["stock"])


@query(f"WITH {_CLEAN}, m AS (SELECT round(sum(score * weight) / sum(weight), 2) AS market_index FROM sn) SELECT market_index, CASE WHEN market_index <= -50 THEN 'Very Bearish' WHEN market_index <= -10 THEN 'Bearish' WHEN market_index < 10 THEN 'Neutral' WHEN market_index < 50 THEN 'Bullish' ELSE 'Very Bullish' END AS mood FROM m")
def n5_x8_market_index(spark, sf_dir):
    return N.market_index(_scored_news(spark, sf_dir))


_NEWS_DAILY = f"WITH {_CLEAN} SELECT stock, CAST(published - INTERVAL 225 MINUTE AS DATE) AS day, avg(score) AS mean_score, avg(score * weight) AS mean_weighted, count(*) AS items FROM sn GROUP BY ALL"


@query(_NEWS_DAILY, "mean_score mean_weighted")
def g1_n6_news_daily(spark, sf_dir):
    return streams.stream_news_daily(_scored_news(spark, sf_dir))


@query(f"WITH {_CLEAN} SELECT link, score FROM sn", "score")
def n3_sentiment_score(spark, sf_dir):
    return _scored_news(spark, sf_dir).select("link", "score")


@query()
def n3_learned_sentiment(spark, sf_dir):
    """News scored by a model of ``labels`` (toxic for negative), learned from a bounded sample of labelled texts; held-out rows are marked."""
    items = _prepared(spark, sf_dir)
    held = F.crc32(C("link").cast("binary")) % 5 == 0
    labels = table(spark, sf_dir, "labels").select(C("doc_id").cast("string").alias("link"), (1 - C("toxic")).cast("int").alias("positive"))
    # of all labelled texts the sample alone is cleaned, once for the learner's passes
    known = news(spark, sf_dir).dropna(subset=["title", "stock"]).select("link", "title").join(labels, "link")
    sample = bounded_sample(known.filter(~held), "positive", "link").withColumn("clean_title", N.clean_text(C("title"))).drop("title")
    model = fit_sentiment(files.settled(sample, "rows", 1000))
    return score_learned(items.select("stock", "link", "weight", "clean_title"), model).withColumn("held_out", held).drop("clean_title")


def _ticks(df):
    return df.select(C("event_type").alias("Ticker"), C("ts").cast("timestamp").alias("ts"), C("value").alias("price"), C("event_id").alias("order"), F.lit(1.0).alias("size"))


_EVENT_BARS = """SELECT event_type AS Ticker, date_trunc('hour', ts) AS Date, first(value ORDER BY ts, event_id) AS Open, max(value) AS High, min(value) AS Low, last(value ORDER BY ts, event_id) AS Close, count(*)::DOUBLE AS Volume FROM events GROUP BY 1, 2"""


@query(_EVENT_BARS)
def g2_bars_from_ticks(spark, sf_dir):
    return streams.stream_bars(_ticks(table(spark, sf_dir, "events")))


def _read_stream(spark, sf_dir, name):
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    return reader.parquet(path) if _is_folder(spark, path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query(_EVENT_BARS)
def g2_stream_bars(spark, sf_dir):
    """The same through Structured Streaming: every window of the folder's files, processed as far as they are there."""
    out = files.shared_folder(spark, "streams")
    return streams.run_available(streams.stream_bars(_ticks(_read_stream(spark, sf_dir, "events"))), f"{out}/bars", f"{out}/checkpoint")


@query(_NEWS_DAILY, "mean_score mean_weighted")
def g1_stream_news_daily(spark, sf_dir):
    """Daily sentiment by stock through Structured Streaming over the news folder."""
    items = news_items(_read_stream(spark, sf_dir, "documents"))
    scored = N.score_sentiment(N.prepared(items), lexicon=PROSE)
    out = files.shared_folder(spark, "streams")
    return streams.run_available(streams.stream_news_daily(scored), f"{out}/news", f"{out}/checkpoint")


def _is_folder(spark, path):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


@query(f"WITH {BARS} SELECT Ticker, CAST(Date AS TIMESTAMP) AS Date, Open, High, Low, Close, Volume FROM bars")
def io1_io8_csv_round_trip(spark, sf_dir):
    out = files.shared_folder(spark, "csv")
    files.write_table(bars(spark, sf_dir).withColumn("Date", C("Date").cast("timestamp")), out, format="csv")
    return files.read_bars(spark, out)


@query(f"""WITH {BARS} SELECT '{{"Ticker":"' || Ticker || '","days":' || count(*) || '}}' AS json FROM bars GROUP BY Ticker""")
def io9_json_snapshot(spark, sf_dir):
    return files.as_json(bars(spark, sf_dir).groupBy("Ticker").agg(F.count("*").alias("days")))


@query(f"WITH {BARS} SELECT DISTINCT Date, strftime(Date, '%d-%b-%y') AS a FROM bars")
def x1_parse_date(spark, sf_dir):
    b = bars(spark, sf_dir).select("Date").distinct()
    text = b.select(F.date_format("Date", "dd-MMM-yyyy").alias("t"), F.date_format("Date", "dd-MMM-yy").alias("a"))
    return text.select(N.parse_date(C("t"), ("yyyy-MM-dd", "dd-MMM-yyyy")).alias("Date"), "a")


def _ml(spark, sf_dir):
    b = W.returns(W.rsi(bars(spark, sf_dir)))
    b = b.withColumn("target", (F.lead("Close", 5).over(W.by_date()) > C("Close")).cast("int")).withColumn("range", (C("High") - C("Low")) / C("Close"))
    rows = split_by_ticker(b.dropna(subset=["RSI_14", "target"]))
    return files.settled(rows.select(*KEY, *_FEATURES, "target", "is_test"), "rows")


_FEATURES = ["RSI_14", "log_return", "pct_change", "range", "Volume"]


@query()
def m2_boosted_trees(spark, sf_dir):
    rows = M.with_class_weight(_ml(spark, sf_dir))
    model = M.fitted("boosted", rows.filter("NOT is_test"), _FEATURES, maxIter=20)
    return M.probabilities(model, rows.filter("is_test")).select(*KEY, "target", "prob")


@query()
def m3_grid_search(spark, sf_dir):
    """Two kinds of learner, folds by ticker; of the boosted trees' grid of 48 settings the depths and steps only, with few trees."""
    rows = M.with_class_weight(_ml(spark, sf_dir)).filter("NOT is_test")
    grids = {"boosted": ({"maxDepth": (3, 6), "stepSize": (0.05, 0.1)}, {"maxIter": 10}), "logistic": ({"regParam": (0.0, 0.1), "elasticNetParam": (0.0, 1.0)}, {})}
    out = None
    for kind, (grid, fixed) in grids.items():
        found = M.grid_search(rows, _FEATURES, kind=kind, grid=grid, parallelism=4, **fixed)
        best = max(range(len(found.avgMetrics)), key=lambda k, found=found: found.avgMetrics[k])
        setting = ", ".join(sorted(f"{p.name}={v}" for p, v in found.getEstimatorParamMaps()[best].items()))
        own = rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.lit(setting).alias("setting"), F.lit(float(found.avgMetrics[best])).alias("precision"))
        out = own if out is None else out.unionByName(own)
    return out


@query()
def m4_m5_ensemble_of_saved_models(spark, sf_dir):
    """Three learners are fitted on the training tickers, saved, loaded again and blended on the other tickers."""
    rows, folder = _ml(spark, sf_dir), files.shared_folder(spark, "models")
    M.train_and_save(rows.filter("NOT is_test"), _FEATURES, folder, {"boosted": {"maxIter": 10, "maxDepth": 4}, "forest": {"numTrees": 20, "maxDepth": 6}, "logistic": {}})
    scored = M.score_with_saved(rows.filter("is_test"), folder, {"boosted": 1.0, "forest": 1.0, "logistic": 1.0})
    return scored.select(*KEY, "target", "prob_boosted", "prob_forest", "prob_logistic", "prob")


_REGIME_FEATURES = ["EMA_50", "EMA_200", "RSI_14", "ATR_14", "MACD", "MACD_signal", "BB_Upper", "BB_Lower"]


def _regimes(spark, sf_dir):
    rows = regime_5(suite(spark, sf_dir)).withColumnRenamed("regime_5", "regime")
    return files.settled(rows.select(*KEY, *_REGIME_FEATURES, "regime"), "rows")


@query()
def r6_regime_forest(spark, sf_dir):
    model, test = M.regime_forest(_regimes(spark, sf_dir), _REGIME_FEATURES)
    return model.transform(test).select(*KEY, "regime", "regime_index", "prediction")


@query()
def r6_r7_forecast_by_forest(spark, sf_dir):
    """A forest's mean class probabilities of each ticker's last ten bars, from the saved model, blended with the ticker's own transitions."""
    rows, folder = _regimes(spark, sf_dir), files.shared_folder(spark, "models")
    model, _ = M.regime_forest(rows, _REGIME_FEATURES, trees=40)
    model.write().save(folder)
    found = rows.select(*KEY, "regime")
    return append_forecast(found, forecast(found, 15, M.recent_probabilities(M.load_model(folder), rows)))


@query(f"WITH RECURSIVE {BARS}, ev AS (SELECT Ticker, Date, Open, High, Low, Close, Volume FROM ({_EVENT_BARS})), {_suite_sql('s', 'ev')} SELECT Ticker, Date, Close, EMA_20, EMA_50, EMA_200, MACD, MACD_signal, RSI_14, ATR_14, BB_Upper, BB_Lower FROM s_s", "EMA_20 EMA_50 EMA_200 MACD MACD_signal RSI_14 ATR_14 BB_Upper BB_Lower", 4)
def g2_stream_indicators(spark, sf_dir):
    """Bars of events come as a stream of files; averages and windows of each ticker are state from batch to batch."""
    out = files.shared_folder(spark, "streams")
    files.write_table(streams.stream_bars(_ticks(table(spark, sf_dir, "events"))), f"{out}/bars")
    arriving = spark.readStream.schema(spark.read.parquet(f"{out}/bars").schema).parquet(f"{out}/bars")
    found = streams.run_available(stream_indicators(arriving), f"{out}/indicators", f"{out}/checkpoint", "append")
    return found.drop("regime")


@query(over("Ticker, Date, Open, High, Low, Close, Volume", "bars WHERE length(Ticker) = 2 AND Ticker < '50' AND Date >= DATE '1996-06-01'"))
def io3_vendor_source(spark, sf_dir):
    """Bars written as a vendor delivers them, read through the data source: tickers leave out files, dates leave out rows."""
    out, wanted = files.shared_folder(spark, "vendor"), [str(k) for k in range(10, 50)]
    names = {"Open": "OpenPrice", "High": "HighPrice", "Low": "LowPrice", "Close": "ClosePrice", "Volume": "TotalTradedQuantity"}
    vendor = bars(spark, sf_dir).withColumnsRenamed(names).withColumn("symbol", C("Ticker")).drop("Ticker").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "symbol")  # a number, or few tasks write all the files
    files.write_table(vendor, out, partition_by=["symbol"], format="csv")
    register(spark)
    found = spark.read.format("vendor_bars").load(out)
    return found.filter(C("Ticker").isin(wanted) & (C("Date") >= F.lit("1996-06-01").cast("date")))


@query(over("Ticker, Date, CASE WHEN day(Date) > 20 AND year(Date) >= 1996 THEN Close + 1 ELSE Close END AS Close", "bars WHERE day(Date) > 10 OR year(Date) < 1997"))
def io6_io8_store_of_bars(spark, sf_dir):
    """Two upserts into a lasting store: the second one corrects some bars, and years that it doesn't touch stay as they are."""
    folder, b = files.shared_folder(spark, "store"), bars(spark, sf_dir).select(*KEY, "Close")
    store.upsert(spark, folder, b.filter("day(Date) > 10 OR year(Date) < 1997"))
    store.upsert(spark, folder, b.filter("day(Date) > 20 AND year(Date) >= 1996").withColumn("Close", C("Close") + 1))
    return store.read_store(spark, folder, "Ticker string, Date date, Close double")
