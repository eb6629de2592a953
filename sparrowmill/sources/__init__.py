"""Tables and files that queries read and write."""
