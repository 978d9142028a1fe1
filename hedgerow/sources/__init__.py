"""Readers: source trees, stored findings, expected literals."""
