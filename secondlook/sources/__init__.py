"""Tables in and artifacts out."""
