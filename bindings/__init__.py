"""Wiring of the operators to the driver's tables: Spark bindings, queries and their SQL counterparts."""
