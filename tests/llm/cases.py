"""Rows that operators have to take."""

#: Nulls in id and text, empty and repeated rows, ties.
AWKWARD = [(1, "Hello World"), (2, None), (None, "hello world"), (3, ""), (4, "HELLO WORLD"), (4, "HELLO WORLD"), (5, "a b  c\n\n\nd\t"), (6, "x" * 5000), (7, " "), (None, None)]
