"""Change feeds and streamed completions."""
