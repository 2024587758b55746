"""Sources, bindings and sinks."""
