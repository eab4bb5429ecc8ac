"""Spark jobs over technical planning documents: extract, merge, validate, report."""
