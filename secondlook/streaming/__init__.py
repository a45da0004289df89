"""The same audit over a stream of prediction files."""
