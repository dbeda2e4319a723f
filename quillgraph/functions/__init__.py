"""See the README for what is in here."""
