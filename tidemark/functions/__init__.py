"""Tidemark."""
