"""Operators: profiling, cleaning, features, models, evaluation, decisions."""
