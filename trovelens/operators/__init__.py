"""operators of the trovelens engine."""
