"""Reference data: readers for published files, and the column rules over them."""
