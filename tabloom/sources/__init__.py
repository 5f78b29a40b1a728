"""tabloom.sources."""
