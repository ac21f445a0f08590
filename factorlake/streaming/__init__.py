"""Bars from a stream of events."""
