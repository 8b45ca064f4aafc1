"""Ingest, features, ledger, backtests, models, serving and quality gates, each from DataFrames to DataFrames."""
