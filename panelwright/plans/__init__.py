"""Feature tables and the end-to-end flows built from the operators."""
