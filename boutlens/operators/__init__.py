"""Operators over generic DataFrames: history, features, scoring, entities, odds, quality, models, ledger."""
