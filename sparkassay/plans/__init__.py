"""Whole jobs composed from the operators: campaign replay, audit, surrogate build and search."""
