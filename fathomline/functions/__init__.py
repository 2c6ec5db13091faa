"""Column functions and the Python functions behind them."""
