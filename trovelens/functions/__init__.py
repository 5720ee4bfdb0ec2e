"""functions of the trovelens engine."""
