"""Demand, stock and purchasing tables as Spark DataFrame jobs."""
