"""Inputs: adapters over the star-schema tables, part files, feeds, weights, service tables."""
