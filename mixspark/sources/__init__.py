"""Reading and writing, and the mixed view all operators work on."""
