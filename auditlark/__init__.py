"""Security-event analytics as PySpark DataFrame operators.

``sources`` turns raw log text into the canonical event table, ``operators``
derives detections, anomalies, enrichment and governance tables from it,
``streaming`` runs the same work on unbounded input, and ``plans`` wires
operators into the named queries that the driver checks.
"""

__version__ = "0.1.0"
