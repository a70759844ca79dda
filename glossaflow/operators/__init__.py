"""DataFrame operators: summaries, joins, manifests, checks, selection, collection."""
