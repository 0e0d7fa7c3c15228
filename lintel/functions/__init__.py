"""Part of the lintel engine."""
