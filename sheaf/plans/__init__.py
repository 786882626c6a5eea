"""Registered queries: each applies operators to whole tables and has its SQL where SQL can express it."""
