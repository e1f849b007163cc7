"""Column expressions shared by the candle operators."""
