"""Joins between tables that describe the same entities under unlike keys, on Spark."""
