"""plans of the trovelens engine."""
