"""tabloom.operators."""
