"""Timing of layouts against a workload, and what it recommends."""
