"""Normalised column names, for matching only; frames keep the raw ones."""

from __future__ import annotations

import re

#: Common abbreviations of warehouse columns.
ALIASES = {
    "cust_id": "customer_id", "cust": "customer", "amt": "amount", "dt": "date", "ord": "order", "qty": "quantity", "cnt": "count",
    "addr": "address", "org": "organization", "dept": "department", "emp": "employee", "prod": "product", "cat": "category",
    "info": "information", "desc": "description", "no": "number", "ts": "timestamp",
    "createtime": "create_time", "modifytime": "modify_time", "updatetime": "update_time", "inserttime": "insert_time",
    "starttime": "start_time", "endtime": "end_time", "statdate": "stat_date", "regioncode": "region_code", "ordercode": "order_code",
    "ref": "reference", "src": "source", "dst": "destination", "grp": "group", "typ": "type", "val": "value", "min": "minimum", "max": "maximum",
    "avg": "average", "tot": "total", "attr": "attribute", "init": "initial", "prev": "previous", "curr": "current", "next": "next",
}


def normalise(name: str, aliases: dict[str, str] | None = ALIASES, prefixes: tuple[str, ...] = ()) -> str:
    """Snake case, lower case, aliases (the whole name, else each part), one prefix off, letters and digits only."""
    known = aliases or {}
    snake = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", name).lower()
    snake = known.get(snake) or "_".join(known.get(p, p) for p in snake.split("_"))
    for p in prefixes:
        if snake.startswith(p) and len(snake) > len(p):
            snake = snake[len(p) :]
            break
    return re.sub(r"_+", "_", re.sub(r"[^\w]", "", snake)).strip("_")


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def row_count(text: str | int | None) -> int | None:
    """A count from a figure such as 5000, "~500万" or "8千"; nothing from anything else."""
    if text is None or isinstance(text, int):
        return text
    m = re.fullmatch(r"[~≈约]?\s*([\d,.]+)\s*([千万亿kKmM]?)\s*[行条]?", text.strip())
    scale = {"": 1, "千": 10**3, "万": 10**4, "亿": 10**8, "k": 10**3, "m": 10**6}
    return int(float(m[1].replace(",", "")) * scale[m[2].lower()]) if m else None
