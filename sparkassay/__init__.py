"""Experiment analytics for very large collections of repeated stochastic trials, on Spark."""
