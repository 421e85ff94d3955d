"""Streaming wrappers around the stateless operators."""
