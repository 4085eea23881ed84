"""Brute-force versions that several tests hold results against."""

import re

from cairn.llm import secrets


def base_spans(t):
    out = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(out + [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def every_span(t):
    """Base spans and candidates of weak kinds in a text, then only what is reported, by brute force."""
    parts = base_spans(t)
    parts += [(m.start(), 6, m.end(), "short_assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) < 6]
    parts += [(m.start(), 7, m.end(), "short_access") for m in re.finditer("AKIA[A-Z0-9]+", t) if 8 <= len(m[0]) < 20]
    parts += [(m.start(), 8, m.end(), "short_hex") for m in re.finditer("[0-9a-f]+", t) if 16 <= len(m[0]) < 24]
    parts += [(m.start(), 3, m.end(), "key") for m in re.finditer("[A-Za-z0-9+/=_-]+", t) if re.fullmatch("[A-Za-z0-9+/]{40}", m[0]) and all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))]
    parts += [(m.start(), 4, m.end(), "login") for m in re.finditer(r"""(user|username|login|client_id|account|account_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", t, re.I | re.A)]
    parts += [(m.start(), 5, m.end(), "endpoint") for m in re.finditer(r"""(https?|postgres|postgresql|mysql|mongodb|redis|amqp|s3)://[^\x20\x09-\x0D"'<>]{4,}""", t)]
    ends = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", t)]
    scope = lambda s: sum(e < s for e in ends)
    role = secrets.ROLES
    return sorted(p for p in parts if p[1] < 3 or any(role[q[3]] != role[p[3]] and scope(q[0]) == scope(p[0]) for q in parts))


def exact_components(rows):
    sets = {}
    for i, t in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or ({tuple(words)} if words else set())
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: (len(sets[i]), find(i)) for i in ids}
