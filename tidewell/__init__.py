"""Probabilistic forecasting over panels of weekly series, as DataFrame operators."""
