"""Verdicts over a stream of units. The expressions hold no state, so the batch ones serve."""
