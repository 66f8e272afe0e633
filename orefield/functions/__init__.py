"""Part of the orefield engine."""
