"""Queries of the analytics engine over the driver's tables, with their SQL."""

from tidemark.queries import books, desk, ingest, market, merges, ratios, raw, streams, texts

QUERIES = {**market.QUERIES, **books.QUERIES, **desk.QUERIES, **ingest.QUERIES, **merges.QUERIES, **ratios.QUERIES, **raw.QUERIES, **streams.QUERIES, **texts.QUERIES}
ORACLE = {**market.ORACLE, **books.ORACLE, **desk.ORACLE, **ingest.ORACLE, **merges.ORACLE, **ratios.ORACLE, **raw.ORACLE, **streams.ORACLE, **texts.ORACLE}


def flagship(spark, sf_dir):
    """Leaders by distance from their 20-day average."""
    return QUERIES["TA_01_TK_01_sma_leaders"](spark, sf_dir)
