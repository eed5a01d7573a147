"""Composed flows: features for every bout, scoring, backtests, training."""
