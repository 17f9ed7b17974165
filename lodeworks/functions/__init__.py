"""Scalar functions on columns, and the plain-Python rules behind them."""
