"""Whole jobs built from the operators, and the catalogue of checked queries."""
