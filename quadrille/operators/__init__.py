"""Operators on graphs of quads: triple sets, lists and containers, OWL views."""
