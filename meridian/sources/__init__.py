"""Where catalog documents and embeddings come from."""
