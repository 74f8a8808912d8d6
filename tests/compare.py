"""Rows of a query and of its DuckDB SQL, in a form that can be compared."""

import glob
import os

import duckdb
import numpy as np


def connection(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(frame):
    def cell(v):
        if isinstance(v, (float, np.floating)):
            return f"{v + 0.0:.6f}"
        return str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))
