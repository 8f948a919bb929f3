"""Alphabets, genetic codes and scalar column functions."""
