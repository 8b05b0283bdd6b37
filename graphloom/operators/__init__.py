"""Distributed operators, one module per family."""
