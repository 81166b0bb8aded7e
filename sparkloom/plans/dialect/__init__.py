"""The SQL dialect: text to DataFrames."""

from sparkloom.plans.dialect.engine import Engine

__all__ = ["Engine"]
