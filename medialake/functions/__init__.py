"""Part of medialake."""
