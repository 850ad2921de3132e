"""Five records behind both dialects."""

ROWS = [{"id": k, "description": f"row {k}"} for k in range(5)]


def offset(params):
    assert params["$order"] == ":id"
    rows = ROWS if "$where" not in params else [r for r in ROWS if r["id"] >= 2]
    return rows[params["$offset"] : params["$offset"] + params["$limit"]]


def feature(params):
    at, n = params["resultOffset"], params["resultRecordCount"]
    return {"features": [{"attributes": {"OBJECTID": r["id"], "NOTES": r["description"]}, "geometry": {"x": 1.0}} for r in ROWS[at : at + n]], "exceededTransferLimit": at + n < len(ROWS)}
