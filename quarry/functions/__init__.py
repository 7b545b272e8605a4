"""Functions of the retrieval and conversation engine."""
