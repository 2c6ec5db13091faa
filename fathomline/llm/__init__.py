"""Operators for preparing training text: mixing, filters, token counts and de-duplication."""
