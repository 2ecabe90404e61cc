"""Operators of the event-camera engine."""
