"""Plain-Python versions of the operators' definitions, for small inputs."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def rules(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall("[#*$%&|<>]", text)), "n_dup_lines": dups, "n_repeat_words": len(covered), "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w)}


def shingle_set(text):
    w = WORD.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def near_duplicates(docs: dict) -> dict:
    """doc_id: (set size, smallest id of the component)."""
    sets = {k: shingle_set(t) for k, t in docs.items()}
    where = defaultdict(set)
    for k, s in sets.items():
        for x in s:
            where[x].add(k)
    top = {k: k for k in docs}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for k, s in sets.items():
        shared = Counter(o for x in s for o in where[x] if o < k)
        for o, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n):
                a, b = find(k), find(o)
                top[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in docs}


def repeated_bytes(docs: list, length: int) -> list:
    """For each text: (bytes, removed, runs, sha256 of the rest)."""
    data = [(t or "").encode() for t in docs]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), runs, sha256(bytes(c for c, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def lines(docs: list, min_docs: int = 10) -> list:
    key = lambda line: lower(line.strip("\x20\t\n\x0b\x0c\r"))
    split = [(t or "").split("\n") for t in docs]
    found = Counter(k for ls in split for k in {key(x) for x in ls} if k)
    out = []
    for ls in split:
        left = [x for x in ls if found[key(x)] < min_docs]
        out.append((len(ls), len(ls) - len(left), sha256("\n".join(left).encode()).hexdigest()))
    return out


ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    base = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
    return (*(sum(k == i for _, k, _ in spans) for i in range(3)), base, sha256(base.encode()).hexdigest())


def tokens(text):
    return [*WORD.findall(lower(text or "")), None]


def held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 7 == 2
