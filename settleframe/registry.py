"""Every analysis by key, over the stand-ins for the test tables, with doubles rounded for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import round_trips
from .functions.columns import chart_table, quarter_label, quarter_short, rounded
from .operators import book, categories, chain
from .operators import tests_of_significance as tests
from .sources import ingest, landed
from .sources.tables import Tables, stand_in_tables

Analysis = Callable[[Tables], DataFrame]


def _blocks(t: Tables) -> DataFrame:
    samples = t.blocks.selectExpr("block_number", "unix_timestamp(cast(timestamp as timestamp)) as ts")
    return ingest.interpolate_blocks(samples)


def _recorded_blocks(t: Tables) -> DataFrame:
    return ingest.iso_blocks(t.blocks.selectExpr("block_number", "unix_timestamp(cast(timestamp as timestamp)) as ts"))


def _volume_chart(t: Tables, label=quarter_label) -> DataFrame:
    by = book.volume_over_time(t).select(label("quarter").alias("quarter"), (F.col("volume") / 1e3).alias("volume"))
    return chart_table(by, "quarter", {"volume": "volume_thousands"})


def _from_cube(analysis: Callable[..., DataFrame], **given) -> Analysis:
    """The analysis from the position cube, as it reads a stored one."""
    return lambda t: analysis(t, cube=book.position_moments(t), **given)


ANALYSES: dict[str, Analysis] = {
    f.__name__: f
    for f in (
        book.win_rate_by_price, book.mispricing_by_price, book.maker_counterparty_excess, book.maker_returns_by_direction, book.maker_win_rate_by_direction,
        book.ev_yes_vs_no, book.yes_vs_no_by_price, book.trade_size_by_role, book.win_rate_by_trade_size, book.returns_by_hour, book.vwap_by_hour, book.volume_over_time,
        book.longshot_volume_share, book.meta_stats, book.calibration_deviation_over_time, book.position_moments,
        categories.maker_taker_returns_by_category, categories.top_groups, categories.market_types, categories.market_type_hierarchy, categories.market_types_topn,
        tests.statistical_tests, chain.chain_win_rate_by_price, chain.chain_calibration_metrics, chain.chain_volume_over_time, chain.chain_trades_per_block,
        chain.cross_venue_calibration, chain.cross_venue_frames,
    )
}
ANALYSES |= {
    "maker_vs_taker_returns": book.maker_vs_taker_returns,
    "price_bucket_share_pivot": lambda t: book.price_bucket_share_pivot(t, least_usd=1000),
    "maker_taker_gap_over_time": lambda t: book.maker_taker_gap_over_time(t, least=100),
    "chain_market_resolution": chain.market_resolution,
    "test_trade_size_by_role": tests.trade_size_by_role,
    "test_yes_no_asymmetry": tests.yes_no_asymmetry,
    "test_category_gaps": tests.category_gaps,
    "test_trade_size_performance": tests.trade_size_performance,
    "test_maker_direction": tests.maker_direction,
    "pending_tickers": lambda t: ingest.pending_tickers(t.book_markets, t.book_trades),
    "interpolate_blocks": _blocks,
    "iso_blocks": _recorded_blocks,
    "volume_chart": _volume_chart,
    "volume_chart_short": lambda t: _volume_chart(t, quarter_short),
    "cube_win_rate_by_price": _from_cube(book.win_rate_by_price),
    "cube_maker_vs_taker_returns": _from_cube(book.maker_vs_taker_returns),
    "cube_maker_returns_by_direction": _from_cube(book.maker_returns_by_direction),
    "cube_longshot_volume_share": _from_cube(book.longshot_volume_share),
    "cube_maker_taker_gap_over_time": _from_cube(book.maker_taker_gap_over_time, least=100),
    "cube_maker_taker_returns_by_category": _from_cube(categories.maker_taker_returns_by_category),
    "chain_trade_measures": lambda t: ingest.chain_trade_measures(t.chain_trades),
}


def query(analysis: Analysis) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(analysis(stand_in_tables(spark, sf_dir)))


QUERIES = {name: query(f) for name, f in ANALYSES.items()}
QUERIES |= {name: (lambda spark, sf_dir, job=job: rounded(job(spark, sf_dir))) for name, job in landed.JOBS.items()}
QUERIES |= {name: (lambda spark, sf_dir, job=job: rounded(job(spark, sf_dir))) for name, job in round_trips.JOBS.items()}
