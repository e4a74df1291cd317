"""Operators for training-data pipelines: text, chat, web and token data."""
