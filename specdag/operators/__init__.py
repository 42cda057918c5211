"""Lowering of plan steps to DataFrames."""
