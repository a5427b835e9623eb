"""Operators on edge relations (company, supplier)."""
