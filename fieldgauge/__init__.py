"""Forecast verification and denominator conditioning on DataFrames."""
