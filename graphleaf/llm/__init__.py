"""Training-data operators. Nothing else in graphleaf imports this subpackage."""
