"""Data jobs as plain DataFrame functions."""
