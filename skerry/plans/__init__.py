"""End-to-end retrieval plans composed of the operators."""
