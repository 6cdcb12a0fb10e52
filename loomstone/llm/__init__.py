"""Training-data operators: each module holds one operator and its query."""
