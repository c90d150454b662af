"""The same child rows as operators/reports.py, one record at a time in plain Python."""

import json

from pagelore.operators.reports import BUCKETS


def listed(x):
    return [] if x is None else x if isinstance(x, list) else [x]


def child_rows(record, payload):
    try:
        v = json.loads(payload) if payload is not None else None
        while isinstance(v, str):
            v = json.loads(v)
    except ValueError:
        return []
    while isinstance(v, dict) and "snapshot" not in v and "evidence" not in v:
        v = next((v[k] for k in ("data", "result", "response", "payload", "body", "record", "output") if isinstance(v.get(k), dict)), None)
    if not isinstance(v, dict):
        return []
    blocks = listed((v.get("snapshot") or {}).get("blocks"))
    out = [(record, "block", 0, i, b.get("ref")) for i, b in enumerate(blocks, 1)]
    ev = v.get("evidence") or {}
    claims = listed(ev.get("claimOutcomes"))
    if not claims:
        for names in BUCKETS:
            claims += next((listed(ev[n]) for n in names if listed(ev.get(n))), [])
    for i, c in enumerate(claims, 1):
        out.append((record, "claim", 0, i, c.get("claimId")))
        for j, s in enumerate(listed(c.get("supportSnippets")), 1):
            key = s.get("stableRef")
            if key is None:
                key = next((b.get("ref") for b in blocks if b.get("id") == s.get("blockId")), None)
            out.append((record, "snippet", i, j, key))
        if (url := (c.get("citation") or {}).get("url")):
            out.append((record, "citation", i, 1, url))
    return out
