"""Rows of a DataFrame in an order that does not depend on Spark."""


def rows(df, *cols):
    picked = df.select(*cols) if cols else df
    return sorted([tuple(r) for r in picked.collect()], key=lambda t: tuple((v is None, str(v)) for v in t))
