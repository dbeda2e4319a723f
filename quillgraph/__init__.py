"""Attributed-graph analytics and budgeted label selection, expressed as Spark DataFrame plans."""
