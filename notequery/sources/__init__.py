"""Reading and writing notes and logs."""
