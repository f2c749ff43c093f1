"""Plain versions of the operators, one document or pair at a time."""

from __future__ import annotations

import collections
import hashlib
import re

LOWER = {i: i + 32 for i in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(texts, items, window=10):
    known = collections.defaultdict(set)
    for item, text in items:
        w = alnum_words(text)
        if 0 < len(w) < window:
            known[tuple(w)].add(str(item))
        for i in range(len(w) - window + 1):
            known[tuple(w[i : i + window])].add(str(item))
    sizes = {len(k) for k in known}
    out = []
    for text in texts:
        w, hit, ids = alnum_words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = known.get(tuple(w[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    ids |= found
        out.append((len(w), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return out


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def classes(rows, size=4, percent=85):
    """For rows (doc_id, text): (n, smallest doc_id of the class)."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = collections.Counter((a, b) for own in holders.values() for i, b in enumerate(own) for a in own[:i])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(len(s), least.get(find(i))) for i, s in enumerate(sets)]


def repeats(rows, size=50):
    """For rows (doc_id, text): (bytes, removed bytes, runs, digest of what stays)."""
    least: dict[bytes, int] = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        if d is not None:
            for i in range(len(b) - size + 1):
                least[b[i : i + size]] = min(d, least.get(b[i : i + size], d))
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if d is not None and least[b[i : i + size]] < d:
                gone[i : i + size] = b"\1" * size
        kept = bytes(x for x, y in zip(b, gone) if not y)
        n = sum(1 for i, y in enumerate(gone) if y and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return out


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    """(start, order of kind, end, kind) of each base span."""
    out = []
    for k, (kind, pattern) in enumerate(PERSONAL.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def quality_counts(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            inside.update(range(i, i + 8))
    n = len(inside)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), n, len(w) < 20 or 100 * n > 30 * len(w)


def license_places(text, phrases):
    w, places, labels = alnum_words(text), [], set()
    for phrase, label in phrases.items():
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    first, last = (min(places), max(places)) if places else (None, None)
    return len(w), len(places), first, last, ",".join(sorted(labels))


def rebuilt(rows):
    """For rows (conv_id, turn, role, text): the rebuilt conversations by id."""
    import zlib

    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        donor = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(donor, [])[:h] + turns[h:]
    return out


def prefix_nodes(rows):
    """The nodes of the prefix tree of the rebuilt conversations."""
    members = collections.defaultdict(list)
    full = rebuilt(rows)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return [
        (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
            sha(",".join(map(str, sorted(c for c in m if len(full[c]) == len(p))))),
        )
        for p, m in members.items()
    ]
