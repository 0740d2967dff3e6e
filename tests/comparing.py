"""Rows of either engine in one form, so that they can be compared whatever their order."""

import datetime
import decimal
import math


def canonical(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v else "0"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(map(canonical, v))
    if isinstance(v, datetime.datetime):
        return (v.astimezone(datetime.timezone.utc) if v.tzinfo else v).replace(tzinfo=None).isoformat()
    return str(v)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(canonical(r[k]) for k in order) for r in rows), key=lambda r: tuple("" if x is None else "~" + str(x) for x in r))
