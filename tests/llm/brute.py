"""Plain-Python statements of the contracts, for small tables."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(zip(w, w[1:], w[2:], w[3:], w[4:]))


def jaccard_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    out = []
    for i, (k, _) in enumerate(rows):
        known = [x for x in groups[find(i)] if x is not None]
        out.append((k, len(sets[i]), min(known) if known else None))
    return out


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def line_dedup(rows):
    docs = collections.defaultdict(set)
    for k, t in rows:
        for line in (t or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
            if len(key) >= 40:
                docs[key].add(k)
    common = {key: max(ks) for key, ks in docs.items() if len(ks) >= 5}
    out = []
    for k, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if common.get(x.strip(" \t\n\x0b\x0c\r").translate(LOWER), k) == k]
        out.append((k, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def quality(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {p for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for p in (i, i + 1, i + 2)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))


# -- fingerprints, one lane and one triple at a time -------------------------------
FULL = (1 << 64) - 1
MIXES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def _word(w):
    return int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")


def _stir(x, k):
    x = ((x ^ (x >> 31) ^ (k + 1)) * MIXES[k]) & FULL
    x = ((x ^ (x >> 29)) * MIXES[(k + 1) % 4]) & FULL
    return x ^ (x >> 32)


def _feature_hashes(paragraph):
    h = [_word(w) for w in WORD.findall(paragraph)]
    if len(h) >= 3:
        return [(((a * MIXES[0] + (b ^ (a >> 17))) * MIXES[1]) + (c ^ (b >> 13)) * MIXES[2]) & FULL for a, b, c in zip(h, h[1:], h[2:])]
    if len(h) == 2:
        return [(h[0] * MIXES[3] + h[1] * MIXES[2] + 1) & FULL]
    return [h[0] * MIXES[3] & FULL] if h else []


def fingerprint(text):
    """(8 sums of 64 bits, 256 signed sums) of a text's paragraphs."""
    exact, near = [0] * 8, [0] * 256
    for p in (text or "").split("\n"):
        d = hashlib.blake2b(p.encode(), digest_size=64).digest()
        for i in range(8):
            exact[i] = (exact[i] + int.from_bytes(d[8 * i:8 * i + 8], "little")) & FULL
        for x in _feature_hashes(p):
            for k in range(4):
                bits = _stir(x, k)
                for j in range(64):                            # bytes in order, the highest bit of a byte first
                    near[64 * k + j] += 1 if bits >> (8 * (j // 8) + 7 - j % 8) & 1 else -1
    return exact, near


def fingerprint_hex(fp):
    return b"".join(x.to_bytes(8, "little") for x in fp[0]).hex() + b"".join((x & 0xFFFFFFFF).to_bytes(4, "little") for x in fp[1]).hex()


def likeness(a, b):
    if a[0] == b[0]:
        return 1.0
    dot, x, y = (sum(p * q for p, q in zip(u, v)) for u, v in ((a[1], b[1]), (a[1], a[1]), (b[1], b[1])))
    return min(1.0, max(0.0, dot / (x * y) ** 0.5)) if x and y else 0.0
