"""Sinks of the event-camera engine."""
