"""sources of the trovelens engine."""
