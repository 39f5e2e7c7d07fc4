"""Operators over DataFrames: islands, spines, as-of lookups, marks, upserts, cascades, limits, nearest rows, components."""
