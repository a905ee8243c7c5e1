"""Relational operators: joins, grids, windows, concepts, cohort, features, QA."""
