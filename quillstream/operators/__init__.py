"""Relational operators expressed as DataFrame plans."""
