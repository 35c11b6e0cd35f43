"""Ventilation specifications, catalogue mapping and price search as Spark jobs."""
