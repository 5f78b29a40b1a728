"""tabloom.functions."""
