"""DataFrame operators: everything here takes and returns ``DataFrame`` objects."""
