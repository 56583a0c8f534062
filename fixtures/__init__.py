"""Test inputs derived from the given tables; no part of the engine."""
