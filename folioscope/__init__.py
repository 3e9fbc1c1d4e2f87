"""Folioscope: queries over hierarchical, annotated text corpora on Spark."""
