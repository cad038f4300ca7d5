"""DataFrame operators: linking, components, merging, scoring, projection."""
