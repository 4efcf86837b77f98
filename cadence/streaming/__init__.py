"""Structured Streaming runner for the kernels."""
