"""Compositions of operators: whole stages of the feature, model and monitoring work."""
