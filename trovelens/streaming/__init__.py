"""streaming of the trovelens engine."""
