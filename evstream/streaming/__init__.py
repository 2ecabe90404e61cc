"""Streaming of the event-camera engine."""
