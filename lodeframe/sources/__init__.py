"""Text, zip and binary sources, and sinks."""
