"""Operators for cleaning and linking large text collections before training."""
