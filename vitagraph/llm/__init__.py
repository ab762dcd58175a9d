"""Training-data operators on text and on the corpus. Nothing outside imports this."""
