"""graphleaf: a text-graph analytics engine expressed as Spark plans."""
