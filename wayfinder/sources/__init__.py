"""Catalogs and the tables behind them."""
