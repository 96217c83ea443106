"""Whole jobs and read views composed of the operators."""
