"""Rows every operator must give a defined result for."""

LONG = "wind over the open water and " * 4000
#: Nulls, empty and very long texts, ties, repeated rows, a null key.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (4, LONG), (5, "word"), (None, "word"), (6, "word"), (6, "word")]
SF = "/root/testdata/sf0.001"
