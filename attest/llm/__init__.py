"""Training-data operators: ten corpus operators over documents, conversations and embeddings."""
