"""Kerbline: trajectory and event analytics as Spark DataFrame operators."""
