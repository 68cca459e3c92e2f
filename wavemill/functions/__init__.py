"""Rules and scores as column expressions."""
