"""Scalar semantics that queries share: rounding, medians, text, JSON, dates, bytes, colour."""
