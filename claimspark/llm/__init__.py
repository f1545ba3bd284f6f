"""Operators for training-data pipelines over documents, embeddings and chats.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
