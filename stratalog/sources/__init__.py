"""Tables and logs to read and write."""
