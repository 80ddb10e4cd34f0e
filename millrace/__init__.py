"""Forecasting analytics and corpus operators as ordinary Spark plans."""
