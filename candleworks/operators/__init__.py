"""Features, market structure, targets, metrics, models and chart tables."""
