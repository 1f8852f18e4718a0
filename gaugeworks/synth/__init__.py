"""Synthetic readings of placed sensors."""

from .generate import generate

__all__ = ["generate"]
