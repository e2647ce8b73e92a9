"""Metered-consumption analytics as Spark DataFrame operators."""
