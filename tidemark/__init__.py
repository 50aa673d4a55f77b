"""Spark-native analytics for comparing model outputs and curating the text behind them."""
