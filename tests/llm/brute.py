"""Plain versions of the operators, one row at a time."""

import hashlib

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    out, word = [], ""
    for c in text or "":
        if c in SPACE:
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] * bool(word)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(docs):
    split = [(d, (t or "").split("\n")) for d, t in docs]
    key = lambda line: lower(line.strip(SPACE))
    holders = {}
    for d, lines in split:
        for line in {key(x) for x in lines}:
            holders.setdefault(line, []).append(-(2**63) if d is None else d)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    out = []
    for d, lines in split:
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == (-(2**63) if d is None else d)]
        out.append((d, len(lines), len(lines) - len(kept), digest("\n".join(kept))))
    return out


def shingles(text):
    w = words(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_dedup(docs, percent):
    sets = {d: shingles(t) for d, t in docs}
    part = {d: d for d in sets}

    def find(d):
        while part[d] != d:
            d = part[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                part[max(x, y)] = min(x, y)
    return [(d, len(sets[d]), find(d), find(d) == d) for d in ids]


def substring_dedup(docs, width=13):
    split = {d: words(t) for d, t in docs}
    first = {}
    for d in sorted(split):
        w = split[d]
        for i in range(len(w) - width + 1):
            first.setdefault(tuple(w[i : i + width]), d)
    out = []
    for d, w in split.items():
        gone = {j for i in range(len(w) - width + 1) if first[tuple(w[i : i + width])] < d for j in range(i, i + width)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), digest(" ".join(kept))))
    return out


def longest_repeats(w):
    out = []
    for i in range(len(w)):
        best = 0
        for j in range(len(w)):
            k = 0
            while i != j and max(i, j) + k < len(w) and w[i + k] == w[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def repetition(text):
    text = text or ""
    w = words(text)
    best = longest_repeats(w)
    repeat = {j for i, b in enumerate(best) if b >= 3 for j in range(i, i + 3)}
    covered = {j for i, b in enumerate(best) if b >= 10 for j in range(i, i + b)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
    kept = not failed and len(covered) <= 0.5 * len(w) and max(best, default=0) <= 200
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat), failed, kept)
