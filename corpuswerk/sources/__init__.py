"""Readers: every source becomes a DataFrame with an explicit schema."""
