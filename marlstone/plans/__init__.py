"""Requests and their compilation."""
