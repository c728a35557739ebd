"""Loaders, generators and sinks of networks and return series."""
