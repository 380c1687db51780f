"""Sources of documents, and the containers they come in."""
