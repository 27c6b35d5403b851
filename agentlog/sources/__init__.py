"""Readers and writers for raw and processed logs."""
