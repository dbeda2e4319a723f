"""Relational and graph operators as DataFrame functions."""
