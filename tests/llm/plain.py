"""Plain Python versions of joins and scans."""

import hashlib
import re

from graphloom.llm import secrets


def plain_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    return [(i, len(sets[k]), min((x for x in ids[find(k)] if x is not None), default=None)) for k, (i, _) in enumerate(rows)]


def plain_hits(text, items, size):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = word(text), set(), set()
    for item, t in items:
        q = word(t)
        for k in range(max(1, len(q) - size + 1) if q else 0):
            g = q[k : k + size]
            for i in range(len(w) - len(g) + 1):
                if w[i : i + len(g)] == g:
                    hit.update(range(i, i + len(g)))
                    found.add(item)
    ids = ",".join(sorted(map(str, found - {None})))
    return len(w), len(hit), len(found - {None}), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def plain_secrets(text):
    text, out = text or "", []
    base = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I, 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 0, 18), ("hex", "[0-9a-f]+", 0, 0, 16)]
    for k, (kind, pattern, flags, group, least) in enumerate(base):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return sorted(out)


def plain_redact(text):
    spans = [(m[0], m[2]) for m in plain_secrets(text)]
    for rule in secrets.MORE_RULES:
        spans += [m.span() for m in re.finditer(rule.regex, text or "")]
    out, at = "", 0
    for k, (a, b) in enumerate(sorted(spans)):
        if k == 0 or a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return None if text is None else out + text[at:]
