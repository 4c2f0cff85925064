"""Batch operators on trades, bars and indicators."""
