"""Sources and sinks for the binary interchange formats."""
