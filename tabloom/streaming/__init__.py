"""tabloom.streaming."""
