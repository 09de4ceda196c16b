"""Operators over tables of patterns (idx, y, x, pixels), crystal maps, detectors and simulations."""
