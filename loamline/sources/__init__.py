"""Readers of outside formats."""
