"""Gridded spatio-temporal feature tables, catch labels and regional analytics on Spark.

Everything works on long tables keyed by ``(iy, ix, time)``: ``iy``/``ix`` are integer
row/column numbers of a uniform grid and ``time`` is the date of a composite.
Missing observations are SQL ``NULL``.
"""

CELL = ["iy", "ix"]
KEY = ["iy", "ix", "time"]
