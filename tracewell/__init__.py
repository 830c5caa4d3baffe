"""Tracewell: an evidence-first analytics engine on PySpark."""
