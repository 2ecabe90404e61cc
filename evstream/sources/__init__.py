"""Sources of the event-camera engine."""
