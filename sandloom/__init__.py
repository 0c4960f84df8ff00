"""sandloom: a PySpark text-intelligence and retrieval analytics engine."""
