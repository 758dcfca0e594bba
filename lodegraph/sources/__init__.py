"""Readers of facts and projections of the driver tables onto the model."""
