"""sparkloom: a DataFrame-first analytics engine on Apache Spark."""

__version__ = "0.1.0"
