"""Candlestick indicators and signals on Spark DataFrames."""
