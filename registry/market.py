"""Rolling feature queries over the daily bars."""

from pyspark.sql import functions as F

from registry import query
from tidemark.operators import calendar as cal_ops
from tidemark.operators import features, xsec

_F = "return_1d:f mom_12_1:f mom_6_1:f ma_200:f trend:f volatility:f downside_volatility:f"


@query(
    "W1_W5_price_features",
    f"date:d symbol:i {_F}",
    "SELECT * FROM price_features",
)
def _(t):
    return t.price_features


@query(
    "W6_W8_discreteness_and_drawdown",
    "date:d symbol:i information_discreteness:f fip_momentum:f drawdown_quality:f",
    "SELECT * FROM price_features",
)
def _(t):
    return t.price_features


@query(
    "W9_W10_liquidity_features",
    "date:d symbol:i avg_amount_20:f avg_volume_20:f history_days:i",
    """SELECT date, symbol, CASE WHEN count(*) OVER a >= 15 THEN avg(amount) OVER a END AS avg_amount_20,
       CASE WHEN count(*) OVER a >= 15 THEN avg(volume) OVER a END AS avg_volume_20,
       row_number() OVER (PARTITION BY symbol ORDER BY date) AS history_days FROM bars
       WINDOW a AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)""",
)
def _(t):
    return features.liquidity_features(t.bars)


@query(
    "W11_regime_label",
    "date:d close:f ma:f regime:s exposure:f",
    """SELECT *, CASE WHEN close >= ma THEN 'RISK_ON' ELSE 'RISK_OFF' END AS regime,
       CASE WHEN close >= ma THEN 0.95 ELSE 0.30 END AS exposure FROM (
       SELECT date, close, CASE WHEN count(*) OVER w >= 200 THEN avg(close) OVER w END AS ma FROM bench
       WINDOW w AS (ORDER BY date ROWS 199 PRECEDING))""",
)
def _(t):
    return features.regime(t.benchmark)
