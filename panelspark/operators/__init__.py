"""Relational and time-series operators, one plain function each.

Every operator takes a DataFrame first, so ``df.transform(op, ...)`` chains them.
"""
