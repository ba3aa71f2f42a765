"""Plankton-survey analytics as lazy Spark DataFrame operators.

Layers, bottom up: ``functions`` (column expressions with explicit missing-value
rules), ``sources`` (scans and sinks), ``operators`` (DataFrame to DataFrame) and
``plans`` (whole exports built from operators).
"""

__version__ = "0.1.0"
