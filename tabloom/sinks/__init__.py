"""tabloom.sinks."""
