"""Spark-native forecasting ledger: many daily series, features, forecasts, scoring and quality gates."""
