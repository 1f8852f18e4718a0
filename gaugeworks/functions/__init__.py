"""Scalar expressions that operators share."""
