"""End-to-end plans composed from sources, functions and operators."""
