"""Interactions, losses, models, training, prediction and evaluation of graph embeddings."""
