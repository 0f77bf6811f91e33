"""Framed streams, decoded and encoded as their pieces arrive."""
