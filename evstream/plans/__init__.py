"""Plans of the event-camera engine."""
