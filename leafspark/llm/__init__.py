"""Training-data operators. Nothing outside this folder imports it, and it imports nothing of the PDF engine."""
