"""Relational operators over versioned trees."""
