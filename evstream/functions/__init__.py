"""Functions of the event-camera engine."""
