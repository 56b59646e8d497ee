"""Masking of streams: stateless by the same expressions, aliases by keyed state."""
