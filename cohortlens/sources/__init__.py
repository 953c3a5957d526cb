"""Sources and sinks of the star schema."""
