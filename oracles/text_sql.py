"""The fixed sentences as DuckDB string expressions."""

from __future__ import annotations

import re


def fill_sql(template: str, **values: str) -> str:
    out = []
    for piece in re.split(r"(\{[a-z_]+\})", template):
        if not piece:
            continue
        if piece.startswith("{") and piece.endswith("}"):
            out.append(f"CAST(({values[piece[1:-1]]}) AS VARCHAR)")
        else:
            out.append("'" + piece.replace("'", "''") + "'")
    return "(" + " || ".join(out) + ")"
