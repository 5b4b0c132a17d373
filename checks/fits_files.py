"""Writes FITS binary tables, so that the reader has something to read (no FITS library is around)."""

from __future__ import annotations

import os
import uuid

import numpy as np

BLOCK = 2880


def _card(key: str, value) -> bytes:
    if isinstance(value, bool):
        text = f"{'T' if value else 'F':>20}"
    elif isinstance(value, (int, float)):
        text = f"{value:>20}"
    else:
        text = f"'{value:<8}'"
    return f"{key:<8}= {text}".ljust(80).encode()


def _header(cards) -> bytes:
    raw = b"".join(_card(k, v) for k, v in cards) + b"END".ljust(80)
    return raw.ljust(-(-len(raw) // BLOCK) * BLOCK)


def table_bytes(columns, extra=(), heap=b"") -> bytes:
    """A FITS file: columns is [(name, TFORM, big-endian array of rows)], extra more header cards."""
    n = len(columns[0][2])
    raw = [np.ascontiguousarray(a).view(np.uint8).reshape(n, -1) if n else np.zeros((0, 0), np.uint8) for _, _, a in columns]
    width = sum(a.dtype.itemsize * int(np.prod(a.shape[1:], dtype=int)) for _, _, a in columns)
    cards = [("XTENSION", "BINTABLE"), ("BITPIX", 8), ("NAXIS", 2), ("NAXIS1", width), ("NAXIS2", n)]
    cards += [("PCOUNT", len(heap)), ("GCOUNT", 1), ("TFIELDS", len(columns))]
    for i, (name, form, _) in enumerate(columns, 1):
        cards += [(f"TTYPE{i}", name), (f"TFORM{i}", form)]
    body = (np.concatenate(raw, axis=1).tobytes() if n else b"") + heap
    primary = _header([("SIMPLE", True), ("BITPIX", 8), ("NAXIS", 0), ("EXTEND", True)])
    return primary + _header(cards + list(extra)) + body.ljust(-(-len(body) // BLOCK) * BLOCK, b"\0")


def catalog_writer(folder: str):
    """mapInPandas function: each batch of the catalog view becomes one file of the folder."""

    def write(batches):
        import pandas as pd

        for df in batches:
            columns = [
                ("object_id", "K", df.object_id.to_numpy(">i8")),
                ("ra", "D", df.ra.to_numpy(">f8")),
                ("dec", "D", df.dec.to_numpy(">f8")),
                ("z_spec", "D", df.z_spec.to_numpy(">f8", na_value=np.nan)),
                ("quality", "1A", df.quality.to_numpy("S1")),
                ("object_type", "15A", df.object_type.to_numpy("S15")),
            ]
            path = os.path.join(folder, f"{uuid.uuid4().hex}.fits")
            with open(path, "wb") as handle:
                handle.write(table_bytes(columns))
            yield pd.DataFrame({"path": [path], "n": [len(df)]})

    return write
