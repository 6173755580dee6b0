"""Plain versions of the operators for small inputs."""

from __future__ import annotations

import re
from collections import defaultdict


def ascii_lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def shingle_sets(rows, width=5):
    out = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
        out[i] = frozenset(tuple(w[j : j + width]) for j in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    return out


def near_components(rows, percent=75):
    """{id: (set size, least id reachable)} by comparing all pairs that share a shingle."""
    sets = shingle_sets(rows)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            lists[x].append(i)
    seen = set()
    for ids in lists.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                        ra, rb = sorted((find(a), find(b)))
                        parent[rb] = ra
    return {i: (len(sets[i]), find(i)) for i in sets}


def line_dedup(rows, min_docs=10):
    blanks = " \t\n\x0b\x0c\r"
    docs = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = ascii_lower(line.strip(blanks))
            if key and i is not None:
                docs[key].add(i)
    gone = {k for k, v in docs.items() if len(v) >= min_docs}
    return [(i, "\n".join(x for x in (text or "").split("\n") if ascii_lower(x.strip(blanks)) not in gone)) for i, text in rows]


def best_fit(lengths, window):
    """Padding that best-fit decreasing leaves, by linear search."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            best = min(fits)
            room.remove(best)
            room.append(best - n)
        else:
            room.append(window - n)
    return len(room)


def url_verdicts(rows, *, held, depth=6, min_values=20, value_share=0.5, z=1.96, weight=10.0, precision=0.5):
    """{page: (host, path, template, purity, verdict)} of (page, url, bad) rows without explicit rules; ``held`` says which urls are held out."""
    variable = re.compile(r"^(?:\d+|\d{4}-\d{2}(?:-\d{2})?|[0-9a-f]{8,}|[0-9a-f]{8}-[0-9a-f-]{27}|[a-z_-]*\d{3,}[a-z0-9_-]*)(\.[a-z]{1,5})?$", re.I)
    parts, shape = {}, {}
    for i, url, _ in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        segments = (path[1:] if path.startswith("/") else path).split("/")
        cut = [variable.sub(lambda m: "*" + (m[1] or ""), s) for s in segments[:depth]]
        parts[i], shape[i] = (ascii_lower(host), path), tuple(cut + (["**"] if len(segments) > depth else []))
    template = {i: "" for i in parts}
    fit = {i: b for i, u, b in rows if b is not None and not held(u)}
    check = {i: b for i, u, b in rows if b is not None and held(u)}
    for level in range(max(map(len, shape.values()), default=0)):
        groups = defaultdict(lambda: defaultdict(list))
        for i, s in shape.items():
            if len(s) > level:
                groups[parts[i][0], template[i]][s[level]].append(i)
        for kids in groups.values():
            every = [i for ids in kids.values() for i in ids]
            lab = [fit[i] for i in every if i in fit]
            for seg, ids in kids.items():
                mine = [fit[i] for i in ids if i in fit]
                others, differs = len(lab) - len(mine), False
                if mine and others:
                    p = sum(lab) / len(lab)
                    gap = abs(sum(mine) / len(mine) - (sum(lab) - sum(mine)) / others)
                    differs = gap > z * (p * (1 - p) * (1 / len(mine) + 1 / others)) ** 0.5
                many = len(kids) >= min_values and len(kids) >= value_share * len(every)
                for i in ids:
                    template[i] += "/" + ("*" if many or len(kids) > 1 and not differs else seg)
    prior = sum(fit.values()) / len(fit) if fit else 0.0
    share = lambda ids, lean: (sum(fit.get(i, 0) for i in ids) + weight * lean) / (sum(i in fit for i in ids) + weight)
    by_host, by_template = defaultdict(list), defaultdict(list)
    for i in parts:
        by_host[parts[i][0]].append(i)
        by_template[parts[i][0], template[i]].append(i)
    purity = {key: share(ids, share(by_host[key[0]], prior)) for key, ids in by_template.items()}
    best, cut = 0.0, float("inf")
    for at in sorted({int(v * 1000) for v in purity.values()}, reverse=True):
        seen = [check[i] for key, ids in by_template.items() if int(purity[key] * 1000) >= at for i in ids if i in check]
        gain = sum(seen) * (1 - precision) - (len(seen) - sum(seen)) * precision
        if seen and gain > best:
            p, n = sum(seen) / len(seen), len(seen)
            lower = (p + z * z / (2 * n) - z * (p * (1 - p) / n + z * z / (4 * n * n)) ** 0.5) / (1 + z * z / n)
            if lower >= precision:
                best, cut = gain, at / 1000
    out = {}
    for i in parts:
        key = parts[i][0], template[i]
        out[i] = (*parts[i], template[i], purity[key], "block" if purity[key] >= cut else "allow")
    return out
