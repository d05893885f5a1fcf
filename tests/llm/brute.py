"""Plain versions of operators that SQL can't express, for small tables."""

import hashlib
import re


def repeats(docs, k=50):
    """{(id, text): (n_bytes, n_removed, n_spans, kept_sha256)} of (id, text) rows."""
    rows = [((1 << 63) - 1 if i is None else i, (t or "").encode()) for i, t in docs]
    first = {}
    for i, t in rows:
        for p in range(len(t) - k + 1):
            w = t[p : p + k]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - k + 1):
            if first[t[p : p + k]] < i:
                gone[p : p + k] = b"\1" * k
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[i, t] = (len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def components(docs):
    """{id: (n_shingles, component_id)} of (id, text) rows, from all pairs."""
    sets = [(i, shingles(t)) for i, t in docs]
    up = {i: i for i, _ in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(sets[a][0]), root(sets[b][0])))
                up[q] = p
    return {i: (len(s), root(i)) for i, s in sets}


def kept_lines(docs, least=5):
    """The texts of (id, text) rows without their recurring lines."""

    def template(line):
        return re.sub(r"[^ ]*[0-9][^ ]*", "<*>", re.sub(r"[ \t\r\x0b\f]+", " ", line).strip(" ")) or None

    lines = [(t or "").split("\n") for _, t in docs]
    found = [[template(x) for x in own] for own in lines]
    sequences = [tuple(x for x in own if x) for own in found]
    alike = {}
    for t in {x for own in found for x in own if x}:
        words = t.split(" ")
        if len(words) >= 5:
            for k in range(len(words) // 2, len(words)):
                alike.setdefault((k, *words[:k], None, *words[k + 1 :]), set()).add(t)
    variable = {}
    for (k, *_), group in alike.items():
        if len(group) >= least:
            for t in group:
                variable.setdefault(t, set()).add(k)
    name = {t: (tuple(sorted(at)), *(None if k in at else w for k, w in enumerate(t.split(" ")))) for t, at in variable.items()}
    named = [[name.get(x, x) for x in own] for own in found]

    def often(rows):
        have = {}
        for own, sequence in rows:
            for x in own:
                if x:
                    have.setdefault(x, set()).add(sequence)
        return {x for x, s in have.items() if len(s) >= least}

    def leaf(t):
        words = (t or "").split(" ")
        return (len(words), *words[: len(words) // 2]) if len(words) >= 8 else None

    recurring = often(zip(named, sequences))
    leaves = often(([leaf(x) for x in own], s) for own, s in zip(found, sequences))
    alone = [sum(x in recurring or leaf(t) in leaves for x, t in zip(own, all_)) * 2 <= len(s) for own, all_, s in zip(named, found, sequences)]
    votes = {}
    for own, s, a in zip(named, sequences, alone):
        for x in set(own) & recurring:
            votes.setdefault(x, {})[s] = a
    gone = {x for x, v in votes.items() if sum(v.values()) >= least and 4 * sum(v.values()) >= len(v)}
    return ["\n".join(x for x, n in zip(own, names) if n not in gone) for own, names in zip(lines, named)]
