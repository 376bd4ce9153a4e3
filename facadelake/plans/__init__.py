"""Whole plans built from the operators, and the catalogue of named queries."""
