"""Whole jobs: bars to feature table, feature table to model, feature table to chart."""
