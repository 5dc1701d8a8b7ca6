"""A local page function for the paged-search source tests (no network)."""

CORPUS = {"q": [{"link": f"https://x.com/a/{i}", "title": f"T{i}", "snippet": f"s{i}"} for i in range(1, 26)]}


def serve(query, start, num, **_):
    items = CORPUS.get(query, [])
    page = items[start - 1:start - 1 + num]
    nxt = start + len(page) if start - 1 + num < len(items) else None
    return {"items": page, "next_start": nxt}


def empty_forever(query, start, num, **_):
    return {"items": [], "next_start": start + 10}


def failing(query, start, num, **_):
    if start > 1:
        raise RuntimeError("quota exceeded")
    return {"items": CORPUS["q"][:num], "next_start": start + num}


def any_query(query, start, num, **_):
    return {"items": [{"link": f"https://x.com/{query}/{i}", "title": "T", "snippet": "s"} for i in range(start, start + num)], "next_start": start + num}


def only_q7(query, start, num, **_):
    if query != "q7" or num > 1:
        raise RuntimeError("not asked for")
    return any_query(query, start, num)


def serve_or_fail(query, start, num, **_):
    if query == "bad":
        raise RuntimeError("quota exceeded")
    return serve(query, start, num)
